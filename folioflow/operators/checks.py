"""Checks of one rendering of a corpus against others: rates by kind of token, tools, notes, articles, markers, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.common import running_sum
from folioflow.functions.text import tokens
from folioflow.operators.measures import bag_overlap, bag_pairs, rate

#: Letters with marks and the plain ones.
MARKED, PLAIN = "ąćęłńóśźżäöüéèàç", "acelnoszzaoueeac"


def token_kinds(text: Column) -> Column:
    """Tokens three times over, as structs of kind and token: whole, without marks (plain), and numbers only."""
    t = tokens(text)
    as_kind = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token")))
    return F.concat(as_kind("whole", t), as_kind("plain", F.transform(t, lambda x: F.translate(x, MARKED, PLAIN))), as_kind("number", F.filter(t, lambda x: x.rlike(r"^\d+$"))))


def reading_quality(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """Recall and precision of a reading against a text, over whole tokens, tokens without marks and numbers: key, kind, ref, hyp, common, kept, grounded.

    Only keys of both sides are compared. ref, hyp: key, text.
    """
    keys = ref.select(key).distinct().join(hyp.select(key).distinct(), key)

    def bag(df: DataFrame) -> DataFrame:
        kinds = df.join(keys, key, "left_semi").select(key, F.explode(token_kinds(F.col("text"))).alias("x"))
        return kinds.groupBy(F.struct(key, F.col("x.kind").alias("kind")).alias("k"), F.col("x.token").alias("token")).agg(F.count("*").alias("n"))

    scores = bag_overlap(bag(ref), bag(hyp), "k")
    return scores.select(f"k.{key}", "k.kind", "ref", "hyp", "common", "kept", "grounded")


def tool_comparison(reference: DataFrame, tools: dict[str, DataFrame], key: str) -> DataFrame:
    """Micro and macro rates of several tools against one reference: tool, items, ref, hyp, common, micro_kept, micro_grounded, macro_kept.

    All tables are token bags (key, token, n). A tool counts on the keys that it and the reference have.
    """
    parts = []
    for tool, bag in sorted(tools.items()):
        keys = reference.select(key).distinct().join(bag.select(key).distinct(), key)
        parts.append(bag_overlap(reference.join(keys, key, "left_semi"), bag.join(keys, key, "left_semi"), key).withColumn("tool", F.lit(tool)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sums = rows.groupBy("tool").agg(F.count("*").alias("items"), F.sum("ref").alias("ref"), F.sum("hyp").alias("hyp"), F.sum("common").alias("common"), F.round(F.avg("kept"), 6).alias("macro_kept"))
    return sums.withColumns({"micro_kept": rate(F.col("common"), F.col("ref")), "micro_grounded": rate(F.col("common"), F.col("hyp"))})


def note_diagnosis(notes: DataFrame, lines: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Tokens of notes that the lines of their document lack, by where else they stand: key, token, n, place (block, other or nowhere).

    All tables are token bags (key, token, n). other: in the lines of another document.
    """
    missing = bag_pairs(notes, lines, key).filter("a > b").select(key, "token", (F.col("a") - F.col("b")).alias("n"))
    here = blocks.select(key, "token").distinct().withColumn("_here", F.lit(True))
    there = lines.select("token").distinct().withColumn("_there", F.lit(True))
    found = missing.join(here, [key, "token"], "left").join(there, "token", "left")
    return found.select(key, "token", "n", F.when(F.col("_here"), "block").when(F.col("_there"), "other").otherwise("nowhere").alias("place"))


def article_check(tree: DataFrame, reference: DataFrame, layer: DataFrame, key: str) -> DataFrame:
    """Article numbers of the tree against those of a reference and of the text layer: key, num, class.

    class: agreed (in all three), tree_error (reference and layer agree, the tree lacks it), layer_only, tree_only, reference_only, or
    confirmed_by_layer / confirmed_by_reference (the tree and one other). Tables: key, num.
    """
    tagged = lambda df, c: df.select(key, "num").distinct().withColumns({n: F.lit(int(n == c)) for n in ("t", "r", "l")})
    both = tagged(tree, "t").unionByName(tagged(reference, "r")).unionByName(tagged(layer, "l")).groupBy(key, "num").agg(*[F.max(c).alias(c) for c in ("t", "r", "l")])
    code = F.concat(*[F.col(c).cast("string") for c in ("t", "r", "l")])
    names = {"111": "agreed", "011": "tree_error", "001": "layer_only", "100": "tree_only", "010": "reference_only", "101": "confirmed_by_layer", "110": "confirmed_by_reference"}
    return both.select(key, "num", F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[code].alias("class"))


def index_check(artefacts: dict[str, DataFrame], patterns: dict[str, str], key: str) -> DataFrame:
    """Occurrences of each expression in each artefact, documents in which all artefacts agree, and those in which they don't: kind, a count
    per artefact, agreeing, differing. Tables: key, text."""
    kinds = list(patterns)
    rows = None
    for name, df in artefacts.items():
        counts = df.groupBy(key).agg(*[F.sum(F.regexp_count("text", F.lit(p))).alias(k) for k, p in patterns.items()])
        long = counts.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k), F.lit(0)).alias("n")) for k in kinds])).alias("x"))
        own = long.select(key, "x.kind", *[(F.col("x.n") if a == name else F.lit(0).cast("long")).alias(a) for a in artefacts])
        rows = own if rows is None else rows.unionByName(own)
    each = rows.groupBy(key, "kind").agg(*[F.sum(a).alias(a) for a in artefacts])
    equal = F.greatest(*artefacts) == F.least(*artefacts)
    return each.groupBy("kind").agg(*[F.sum(a).alias(a) for a in artefacts], F.count_if(equal).alias("agreeing"), F.count_if(~equal).alias("differing"))


def first_tokens(texts: DataFrame, key: str, position: list[str], most: int = 100) -> DataFrame:
    """The first so many tokens of each document in reading order, as rating material: key, tokens.

    texts: key, position (integers), text. Only texts that begin before the limit are put together.
    """
    sized = texts.withColumn("_tokens", tokens(F.coalesce("text", F.lit(""))))
    placed = running_sum(sized, [key], position, F.size("_tokens"), "_at").filter(F.col("_at") < most)
    parts = F.array_sort(F.collect_list(F.struct("_at", *position, "_tokens")))
    return placed.groupBy(key).agg(F.slice(F.flatten(F.transform(parts, lambda x: x["_tokens"])), 1, most).alias("tokens"))


def within_budget(plan: DataFrame, order: list[str], cost: Column, budget: int, most: int | None = None) -> DataFrame:
    """The rows of a plan that a run may take: in order, as long as the costs before a row stay below the budget, and most of them at most.

    order: integer columns that tell all rows apart.
    """
    rows = running_sum(plan.withColumn("_all", F.lit(0)), ["_all"], order, F.coalesce(cost, F.lit(0)), "_spent")
    rows = running_sum(rows, ["_all"], order, F.lit(1), "_taken") if most is not None else rows
    kept = rows.filter((F.col("_spent") < budget) & ((F.col("_taken") < most) if most is not None else F.lit(True)))
    return kept.drop("_all", "_spent", "_taken")


def tree_strings(nodes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """All strings of tree records by their field and the words in them: key, field, strings, words."""
    long = nodes.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).filter("x.value <> ''")
    return long.groupBy(key, F.col("x.field").alias("field")).agg(F.count("*").alias("strings"), F.sum(F.size(tokens(F.col("x.value")))).alias("words"))
