"""Letter statistics of a corpus: how likely a letter is after the two before it."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = "\x02"
#: Longer tokens are no words; their runs of letters (and signs outside ASCII) are taken one by one.
LONGEST = 60
RUN = re.compile(rf"[A-Za-z\x80-\U0010ffff]{{1,{LONGEST}}}")
_TRIM = "\"'.,;:!?()[]{}<>*_#|/\\-–—„”“«»…"


def plain_token(token: str) -> str:
    """A token without punctuation at its ends, in lower case, digits as 0."""
    t = token.strip(_TRIM).lower()
    return "".join("0" if c.isdigit() and c < "\x80" else c for c in t) if any("0" <= c <= "9" for c in t) else t


def words_of(text: str) -> list[str]:
    """Tokens of a text; of an overlong one its runs of letters."""
    tokens = text.split()
    if len(text) > LONGEST and max(map(len, tokens), default=0) > LONGEST:
        tokens = [w for t in tokens for w in ((t,) if len(t) <= LONGEST else RUN.findall(t))]
    return tokens


def letter_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Counts of all runs of one to three letters of the tokens of all texts: gram, n."""
    source = texts.select(F.col(column).alias("t")).filter("t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        grams: Counter = Counter()

        def drain() -> None:
            for token, n in tokens.items():
                t = plain_token(token)
                if t:
                    s = EDGE + EDGE + t + EDGE
                    for i in range(2, len(s)):
                        grams[s[i]] += n
                        grams[s[i - 1 : i + 1]] += n
                        grams[s[i - 2 : i + 1]] += n
                    grams[EDGE + EDGE] += n
            tokens.clear()

        def batch_of() -> pa.RecordBatch:
            arrays = [pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())]
            grams.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["gram", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens.update(words_of(text))
            if len(tokens) > 300_000:
                drain()
            if len(grams) > 500_000:
                yield batch_of()
        drain()
        yield batch_of()

    return source.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def collect_model(counts: DataFrame, most: int = 600_000) -> Letters:
    """The most frequent letter runs as a model on the driver, at most so many."""
    rows = counts.orderBy(F.desc("n"), "gram").limit(most).collect()
    return Letters({r.gram: r.n for r in rows})


class Letters:
    """Interpolated trigram model of letters. cost is the negative natural logarithm of the probability."""

    K = 2.0

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.total = sum(n for g, n in counts.items() if len(g) == 1) or 1
        self.known = sum(len(g) == 1 for g in counts) + 50
        self.cache: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        found = self.cache.get(gram)
        if found is None:
            get = self.counts.get
            k = self.K
            p1 = (get(gram[2], 0) + 0.1) / (self.total + 0.1 * self.known)
            p2 = (get(gram[1:], 0) + k * p1) / (get(gram[1], 0) + k)
            p3 = (get(gram, 0) + k * p2) / (get(gram[:2], 0) + k)
            found = -math.log(p3)
            if len(self.cache) < 2_000_000:
                self.cache[gram] = found
        return found

    def costs(self, token: str) -> list[float]:
        """Cost of each letter of a plain token and of its end."""
        s = EDGE + EDGE + token + EDGE
        return [self.cost(s[i - 2 : i + 1]) for i in range(2, len(s))]
