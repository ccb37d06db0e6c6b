"""Subject areas of documents.

Documents are embedded by term weighting and a truncated singular value decomposition, one space per
language; sentences are folded into the same space. The labelled documents give a seed centroid per
subject and language. The centroids are refined on the sentences of all documents: each sentence that
is clearly nearer to one subject than to any other moves its centroid. A document has the subjects that
hold a stated share of its sentences that treat any subject.

The function words of a text tell its language. Where they don't (none, as many of another language, or
a lead of one word only, which short texts of any language reach by chance), the text has the language
that knows most of its words, as function words or as kept terms.

All counts and sums run over all documents. What reaches the driver is bounded by parameters: the terms
of a language (at most max_terms), the dimensions, and the labelled rows (at most max_labels). Sums are
formed in each partition and added up in a tree.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from folioflow.common import materialize

#: Frequent function words that tell languages apart.
STOP_WORDS = {
    "pl": "się oraz nie jest przez dla lub jeżeli które których pod przy wraz z w na do i o od ze za",
    "en": "the of and to in is for shall by with be or that not from this which are",
    "de": "der die das und ist von mit für nicht den im zu auf dem des sie über ein eine",
    "fr": "le la les et des du que pour dans une est sur par aux en ou qui sont",
    "es": "el los las y del por con una es para como se lo",
    "it": "il gli di che non per una sono della nel con",
    "cs": "se je na že být který podle nebo pro před",
    "ru": "и в не на что с по как для от",
    "uk": "і в не на що з по як для від",
}
LANGUAGES = sorted(STOP_WORDS)
_BREAK = re.compile(r"(?<=[.!?;])\s+(?=[^\W\d_a-ząćęłńóśźżäöüßàâçèéêëîïôùûœæ]|\d+[.)]\s|[§(*\"„])|\n[^\S\n]*\n")
_HEADING = re.compile(r"(?m)^#.*$")
_HYPHEN = re.compile("[-­¬‐]\\s*\\n\\s*")


class _Words(dict):
    """Word -> (feature, language that it is a function word of); both -1 if none."""

    def __init__(self) -> None:
        self.stops: dict[str, int] = {}
        self.shared: dict[str, list[int]] = {}
        for code, name in enumerate(LANGUAGES):
            for w in STOP_WORDS[name].split():
                # a word of several languages tells nothing
                self.stops[w] = -1 if w in self.stops else code
                self.shared.setdefault(w, []).append(code)

    def __missing__(self, word: str) -> tuple[int, int]:
        feature = zlib.crc32(word.encode()) & 0x7FFFFFFF if len(word) > 2 else -1
        found = (feature, self.stops.get(word, -1))
        if len(self) < 2_000_000:
            self[word] = found
        return found


class _Letters(dict):
    def __missing__(self, code: int):
        ch = chr(code)
        self[code] = ch if ch.isalpha() else None if ch in "­​" else " "
        return self[code]


class _Tokens(dict):
    """Token as it stands between blanks -> (feature, language) of each word in it."""

    def __init__(self, words: _Words, letters: _Letters) -> None:
        self.words, self.letters = words, letters

    def __missing__(self, token: str) -> tuple[tuple[int, int], ...]:
        found = tuple([self.words[w] for w in token.lower().translate(self.letters).split()])
        if len(self) < 1_000_000 and len(token) < 40:
            self[token] = found
        return found


def _body(text: str) -> str:
    """Text without heading lines, words cut at the end of a line closed."""
    if "#" in text:
        text = _HEADING.sub("", text)
    if "-\n" in text or "¬" in text or "­" in text or "‐" in text:
        text = _HYPHEN.sub("", text)
    return text


def _features(text: str, tokens: _Tokens) -> tuple[list[int], list[list[int]]]:
    """Function words of each language and the distinct features of each sentence."""
    counts = [0] * len(LANGUAGES)
    out = []
    for sentence in _BREAK.split(_body(text)):
        features = set()
        for token in sentence.split():
            for feature, code in tokens[token]:
                features.add(feature)
                if code >= 0:
                    counts[code] += 1
        features.discard(-1)
        if features:
            out.append(list(features))
    return counts, out


def _leader(counts: list[int]) -> tuple[int, int]:
    """Language of most function words (-1: none or a tie) and its lead over the next."""
    second, best = sorted(counts)[-2:]
    return (counts.index(best) if best > second else -1), best - second


def sentence_features(text: str, words: dict, letters: dict) -> tuple[int, list[list[int]]]:
    """Language code (-1: the function words don't tell) and the distinct features of each sentence; heading lines are left out."""
    counts, out = _features(text, _Tokens(words, letters))
    return _leader(counts)[0], out


_CLEAR = 2  # lead in function words from which they decide the language alone


def _tokenise(df: DataFrame, key: str) -> DataFrame:
    """hits: function words of each language, those of several languages included, where they don't decide; else empty. hint: language stated."""
    code = F.lit(None).cast("int")
    if "lang" in df.columns:
        stated = F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2})([-_].*)?$", 1)
        code = F.create_map(*[x for i, name in enumerate(LANGUAGES) for x in (F.lit(name), F.lit(i))])[stated]
    hint = F.coalesce(code, F.lit(-1)).alias("hint")
    source = df.select(F.col(key).cast("long").alias("doc"), F.col("text").alias("text"), hint).filter("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, letters = _Words(), _Letters()
        tokens = _Tokens(words, letters)
        for batch in batches:
            lang, ids, sizes, hits = [], [], [], []
            for text in batch.column(1).to_pylist():
                counts, sentences = _features(text, tokens)
                code, ahead = _leader(counts)
                if ahead < _CLEAR:
                    found = [c for w in _body(text).lower().translate(letters).split() for c in words.shared.get(w, ())]
                    counts = np.bincount(found, minlength=len(LANGUAGES)).tolist()
                hits.append(counts if ahead < _CLEAR else [])
                lang.append(code)
                ids.append([f for s in sentences for f in s])
                sizes.append([len(s) for s in sentences])
            arrays = [batch.column(0), pa.array(lang, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))]
            arrays += [pa.array([not h for h in hits], pa.bool_()), pa.array(hits, pa.list_(pa.int32())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "lang", "ids", "sizes", "clear", "hits", "hint"])

    return source.mapInArrow(run, f"{_TOKENS}, clear boolean, hits array<int>, hint int")


_TOKENS = "doc long, lang int, ids array<int>, sizes array<int>"


class Block:
    """Columns of a batch as arrays: one entry per document, sentence or occurrence."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.doc = batch.column(0).to_numpy(zero_copy_only=False)
        self.lang = batch.column(1).to_numpy(zero_copy_only=False)
        ids, sizes = batch.column(2), batch.column(3)
        self.ids = ids.flatten().to_numpy(zero_copy_only=False)
        self.sizes = sizes.flatten().to_numpy(zero_copy_only=False)
        per_doc = np.diff(sizes.offsets.to_numpy())
        self.sentence_doc = np.repeat(np.arange(len(self.doc)), per_doc)
        self.sentence = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.owner = self.sentence_doc[self.sentence] if len(self.sentence) else self.sentence

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature)."""
        both = np.unique((self.owner.astype(np.int64) << 32) | self.ids.astype(np.int64))
        return (both >> 32).astype(np.int64), (both & 0xFFFFFFFF).astype(np.int64)


def _count(tokens: DataFrame) -> DataFrame:
    """Documents per language and feature; feature -1 counts the documents of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            b = Block(batch)
            docs, features = b.pairs()
            own = np.concatenate([(b.lang[docs].astype(np.int64) << 32) | features, (b.lang.astype(np.int64) << 32) | 0x80000000])
            own = own[own >= 0]
            k, n = np.unique(own, return_counts=True)
            keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
            if len(keys) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return tokens.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame, least_share: float, most_share: float, max_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (language << 32 | feature) and their weights, the logarithm of inverse document frequency."""
    counts = counts.withColumn("lang", F.shiftright("key", 32))
    total = counts.filter(F.col("key").bitwiseAND(0xFFFFFFFF) == 0x80000000).select("lang", F.col("n").alias("docs"))
    terms = counts.filter(F.col("key").bitwiseAND(0xFFFFFFFF) != 0x80000000)
    share = F.col("n") / F.col("docs")
    # one row per language on the right side
    kept = terms.join(F.broadcast(total), "lang").filter((F.col("n") >= 3) & (share >= least_share) & (share <= most_share))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    rows = kept.withColumn("rank", rank).filter(F.col("rank") <= max_terms).select("key", F.log(F.col("docs") / F.col("n")).alias("w")).collect()
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float32)


def _settle(unclear: DataFrame, keys: np.ndarray) -> DataFrame:
    """Language of texts whose function words don't decide: the one that knows most of their words.

    Of languages that know as many, the one of most function words, then the one stated with the document, then the one of
    most kept terms. A text without a known word has the language stated.
    """
    shared = unclear.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms = (shared.value >> 32).astype(np.int64), shared.value & 0xFFFFFFFF
        codes = np.arange(len(LANGUAGES))
        own = [terms[lang == c] for c in codes]
        size = np.array([len(t) for t in own])
        for batch in batches:
            chosen = []
            for ids, hits, hint in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                hits, stated = np.array(hits), codes == hint
                known = hits + [len(np.intersect1d(ids, t)) for t in own]
                chosen.append(int(np.lexsort((size, stated, hits, known))[-1]) if known.any() else hint)
            arrays = [batch.column(0), pa.array(chosen, pa.int32()), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "lang", "ids", "sizes"])

    return unclear.mapInArrow(run, _TOKENS)


def _remap(tokens: DataFrame, keys: np.ndarray) -> DataFrame:
    """Features as places in the vocabulary; others are left out, sentences stay."""
    shared = tokens.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            b = Block(batch)
            wanted = (b.lang[b.owner].astype(np.int64) << 32) | b.ids
            at = np.searchsorted(vocabulary, wanted)
            good = (at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == wanted) if len(vocabulary) else np.zeros(len(at), bool)
            per_sentence = np.bincount(b.sentence[good], minlength=len(b.sizes))
            keep = per_sentence > 0
            per_doc = np.bincount(b.owner[good], minlength=len(b.doc))
            sentences = np.bincount(b.sentence_doc[keep], minlength=len(b.doc)) if len(b.sizes) else np.zeros(len(b.doc), int)
            offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            arrays = [
                batch.column(0), batch.column(1),
                pa.ListArray.from_arrays(offsets(per_doc), pa.array(at[good].astype(np.int32))),
                pa.ListArray.from_arrays(offsets(sentences), pa.array(per_sentence[keep].astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "lang", "ids", "sizes"])

    return tokens.mapInArrow(run, _TOKENS)


def _sum_rows(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of consecutive rows of the same group; group ascends."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(group):
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


_CHUNK = 1 << 18  # numbers of a matrix in one row


def _tree_sum(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """Sum over all partitions of a vector of the given size, added up 32 at a time."""
    names = ["part", "at", "numbers"]

    def rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, size, _CHUNK):
            part = total[at : at + _CHUNK].astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([at], pa.int64()), pa.array([part], pa.binary())], names=names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(partial(batches))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.float64)
        for batch in batches:
            for at, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                numbers = np.frombuffer(part, np.float32)
                total[at : at + len(numbers)] += numbers
        yield from rows(total)

    schema = "part int, at long, numbers binary"
    # a whole vector leaves each task, so a few tasks for each core take all partitions
    n = min(df.rdd.getNumPartitions(), 4 * df.sparkSession.sparkContext.defaultParallelism)
    out = df.coalesce(n).mapInArrow(first, schema)
    while n > 1:
        n = -(-n // 32)
        out = out.repartition(n).mapInArrow(add, schema)
    total = np.zeros(size, np.float64)
    for r in out.toLocalIterator():
        numbers = np.frombuffer(r.numbers, np.float32)
        total[r.at : r.at + len(numbers)] += numbers
    return total


def _doc_vectors(b: Block, weights: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    docs, features = b.pairs()
    w = weights[features]
    norm = np.sqrt(np.bincount(docs, weights=w * w, minlength=len(b.doc))) + 1e-12
    w = (w / norm[docs]).astype(np.float32)
    return _sum_rows(basis[features] * w[:, None], docs, len(b.doc)), docs, features, w


def _decompose(rows: DataFrame, keys: np.ndarray, weights: np.ndarray, dims: int, passes: int) -> np.ndarray:
    """Right singular vectors of the weighted document-term matrix, per language, by randomised subspace iteration."""
    n = len(keys)
    basis = np.random.default_rng(7).standard_normal((n, dims)).astype(np.float32)
    lang = keys >> 32
    for _ in range(passes):
        shared = rows.sparkSession.sparkContext.broadcast((weights, basis))

        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            weights, basis = shared.value
            total = np.zeros((n, dims), np.float32)
            for batch in batches:
                b = Block(batch)
                y, docs, features, w = _doc_vectors(b, weights, basis)
                order = np.argsort(features, kind="stable")
                total += _sum_rows(y[docs[order]] * w[order][:, None], features[order], n)
            return total.reshape(-1)

        product = _tree_sum(rows, partial, n * dims).reshape(n, dims)
        basis = np.zeros((n, dims), np.float32)
        for code in np.unique(lang):
            own = np.flatnonzero(lang == code)
            q, _ = np.linalg.qr(product[own])
            basis[own, : q.shape[1]] = q
        shared.destroy()
    return basis


class Model:
    """Vocabulary weights, term vectors and the centroids: rows of centres, each with its language and subject."""

    def __init__(self, weights: np.ndarray, basis: np.ndarray, subjects: list[str]) -> None:
        self.weights, self.basis, self.subjects = weights, basis, subjects
        self.terms = basis * weights[:, None]
        self.centres = np.zeros((len(LANGUAGES), len(subjects), basis.shape[1]), np.float32)
        self.present = np.zeros((len(LANGUAGES), len(subjects)), bool)

    def take(self, sums: np.ndarray) -> None:
        sums = sums.reshape(self.centres.shape)
        found = np.linalg.norm(sums, axis=2) > 1e-9
        self.present |= found
        self.centres[found] = _unit(sums[found]).astype(np.float32)

    def nearest(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vector, nearest subject and its lead over the next subject, for each sentence."""
        vectors = _unit(_sum_rows(self.terms[b.ids], b.sentence, len(b.sizes)))
        lang = b.lang[b.sentence_doc]
        best, lead = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.float32)
        for code in np.unique(lang):
            if code < 0 or self.present[code].sum() < 2:
                continue
            own = np.flatnonzero(lang == code)
            near = vectors[own] @ self.centres[code].T
            near[:, ~self.present[code]] = -1
            top = np.argpartition(near, -2, axis=1)[:, -2:]
            first = near.argmax(1)
            both = np.take_along_axis(near, top, 1)
            best[own], lead[own] = first, np.abs(both[:, 1] - both[:, 0])
        return vectors, best, lead


def _labels(labels: DataFrame, key: str, names: list[str], most: int) -> dict[int, list[int]]:
    """At most so many labelled documents, drawn by the hash of their ids."""
    place = {s: i for i, s in enumerate(names)}
    rows = labels.select(F.col(key).cast("long").alias("doc"), F.lower(F.trim("subject")).alias("subject"))
    rows = rows.filter(F.col("doc").isNotNull() & F.col("subject").isin(names)).distinct()
    out: dict[int, list[int]] = {}
    for doc, subject in rows.orderBy(F.xxhash64("doc"), "doc", "subject").limit(most).collect():
        out.setdefault(doc, []).append(place[subject])
    return out


def train(rows: DataFrame, keys: np.ndarray, weights: np.ndarray, labelled: dict[int, list[int]], names: list[str], dims: int, passes: int, rounds: int, lead: float) -> Model:
    model = Model(weights, _decompose(rows, keys, weights, dims, passes), names)
    size = model.centres.size
    context = rows.sparkSession.sparkContext
    # seeds: labelled documents in their own space
    first = context.broadcast((model, labelled))

    def seeds(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        model, labelled = first.value
        total = np.zeros(model.centres.shape, np.float32)
        wanted = np.array(sorted(labelled), np.int64)
        for batch in batches:
            own = np.flatnonzero(np.isin(batch.column(0).to_numpy(zero_copy_only=False), wanted))
            if len(own):
                b = Block(pa.RecordBatch.from_arrays([c.take(pa.array(own)) for c in batch.columns], names=batch.schema.names))
                vectors = _unit(_doc_vectors(b, model.weights, model.basis)[0])
                for doc, code, v in zip(b.doc, b.lang, vectors):
                    if code >= 0:
                        for s in labelled[int(doc)]:
                            total[code, s] += v
        return total.reshape(-1)

    model.take(_tree_sum(rows, seeds, size))
    for _ in range(rounds):
        shared = context.broadcast(model)

        def refine(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            model = shared.value
            total = np.zeros((model.centres.shape[0] * model.centres.shape[1], model.centres.shape[2]), np.float32)
            for batch in batches:
                b = Block(batch)
                vectors, best, ahead = model.nearest(b)
                own = np.flatnonzero(ahead >= lead)
                place = b.lang[b.sentence_doc[own]] * len(model.subjects) + best[own]
                order = np.argsort(place, kind="stable")
                total += _sum_rows(vectors[own[order]], place[order], len(total))
            return total.reshape(-1)

        model.take(_tree_sum(rows, refine, size))
    return model


def assign_subjects(
    documents: DataFrame, subjects: DataFrame, labels: DataFrame, key: str = "doc_id", share: float = 0.3, lead: float = 0.15,
    dims: int = 40, passes: int = 2, rounds: int = 2, least_share: float = 0.002, most_share: float = 0.2,
    max_terms: int = 8192, max_labels: int = 50_000,
) -> DataFrame:
    """Subjects of each document: key, subject, sentences (that treat it), treated (sentences that treat any).

    A sentence treats the subject whose centroid is nearest if its cosine leads that of every other
    subject by lead. A row for each subject with at least share of the treated sentences; documents
    without text, without such sentences or in a language without labelled documents have none. A column
    lang, if there is one, decides only between languages that know as many words of a text. Labels
    that are NULL or name no row of subjects are ignored; case and outer blanks don't matter. Documents
    delivered twice (same id) give their rows once. Other columns are left out.
    """
    spark = documents.sparkSession
    # the list of subjects is a fixed table, bounded here
    names = sorted(r[0] for r in subjects.select(F.lower(F.trim("subject"))).filter("subject is not null").distinct().limit(10_001).collect())
    if len(names) > 10_000:
        raise ValueError("more than 10,000 subjects")
    shown = {r[0].strip().lower(): r[0] for r in subjects.select("subject").filter("subject is not null").distinct().collect()}
    tokens = materialize(_tokenise(documents, key), "tokens")
    counts = materialize(_count(tokens), "terms")
    keys, _ = _vocabulary(counts, least_share, most_share, max_terms)
    unclear = tokens.filter("not clear")
    settled = materialize(_settle(unclear, keys), "settled")
    # documents that found their language, or another one, count there
    moved = _count(unclear).withColumn("n", -F.col("n")).unionByName(_count(settled))
    counts = materialize(counts.unionByName(moved).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 0"), "terms")
    keys, weights = _vocabulary(counts, least_share, most_share, max_terms)
    tokens = tokens.filter("clear").select("doc", "lang", "ids", "sizes").unionByName(settled)
    rows = materialize(_remap(tokens, keys), "terms")
    model = train(rows, keys, weights, _labels(labels, key, names, max_labels), names, dims, passes, rounds, lead)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n = max(1, len(model.subjects))
        for batch in batches:
            b = Block(batch)
            _, best, ahead = model.nearest(b)
            own = ahead >= lead
            table = np.bincount(b.sentence_doc[own] * n + best[own], minlength=len(b.doc) * n).reshape(len(b.doc), n)
            total = table.sum(1)
            # whole numbers: a share of three tenths must not be lost to rounding
            docs, found = np.nonzero((table > 0) & (table >= share * total[:, None] - 1e-9))
            names = [shown[model.subjects[s]] for s in found]
            arrays = [pa.array(b.doc[docs]), pa.array(names, pa.string()), pa.array(table[docs, found].astype(np.int32)), pa.array(total[docs].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "subject", "sentences", "treated"])

    out = rows.mapInArrow(run, "doc long, subject string, sentences int, treated int").dropDuplicates(["doc", "subject"])
    return out.withColumnRenamed("doc", key)


def composition(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of each subject, whole and in parts (a document counts 1 over all its subjects)."""
    parts = assigned.withColumn("part", 1 / F.count("*").over(Window.partitionBy(key)))
    return parts.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum("part"), 3).alias("parts"))
