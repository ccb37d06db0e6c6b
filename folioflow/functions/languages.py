"""Language by frequent words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent words of each language, languages in order of preference at ties.
STOP_WORDS = {
    "pl": "i w z na się do że nie jest oraz lub przez dla od o który która które być może jego ich zgodnie art",
    "en": "the of and to in a is that for by or be shall as with this any on which are from",
    "fr": "le la les de des et du un une est en par pour dans que qui sur au aux ou être",
    "de": "der die das und zu den des von mit ist im nicht auf für eine ein dem sich oder",
    "pt": "o a os as de do da dos das e em um uma que para por com não ou no na se ao",
    "es": "el la los las de del y en un una que por para con no o se al lo sus",
    "sv": "och att det som en på är av för med till den har de inte om ett eller",
    "it": "il di che e la per un in non una sono della del le si alla dei gli",
    "el": "και το της του να των τα η ο με σε για που την στο οι από",
    # beyond those: languages of treaties and neighbours
    "ru": "и в не на что с по как для от",
    "uk": "і в не на що з по як для від",
    "cs": "se je na že být který podle nebo pro před",
}
LEAST_HITS, LEAST_SHARE = 5, 0.1


def guess(tokens: Column) -> Column:
    """Language with the most frequent-word tokens; '?' with fewer than five of them or than a tenth of the tokens."""
    def count(words: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(words)))

    hits = {lang: count(words.split()) for lang, words in STOP_WORDS.items()}
    ranked = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, (lang, n) in enumerate(hits.items())])
    best = F.array_max(ranked)
    enough = (best["n"] >= LEAST_HITS) & (best["n"] * 10 >= F.size(tokens))
    return F.when(enough, best["lang"]).otherwise("?")


def guess_sql(tokens: str) -> str:
    """The same for the other engine."""
    hits = [f"len(list_filter({tokens}, lambda t: t IN ({', '.join(repr(w) for w in words.split())})))" for words in STOP_WORDS.values()]
    most = f"greatest({', '.join(hits)})"
    cases = " ".join(f"WHEN {h} = {most} THEN '{lang}'" for lang, h in zip(STOP_WORDS, hits))
    return f"CASE WHEN {most} < {LEAST_HITS} OR {most} * 10 < len({tokens}) THEN '?' {cases} END"
