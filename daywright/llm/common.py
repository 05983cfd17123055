"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daywright.settings import scratch_path

#: White space that parts words: space and the ASCII controls tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> tuple[str, str]:
    """One public byte-level vocabulary in two forms, for two encoders."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows written once to the shared folder, with these options of the writer, and read back.

    It cuts the lineage: after the loss of an executor the readers start from the files, and what
    was decided from one reading holds for every later one. The folder belongs to the cluster,
    which clears it as it clears checkpoints.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table doesn't have (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def each(batch, name: str) -> Iterator:
    """The values of a column of an Arrow batch, made one at a time: a list of them would hold the whole batch again."""
    return (x.as_py() for x in batch.column(name))


def words(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


class WordIds(dict):
    """Number of each distinct word met by a worker, with a 64-bit hash that is the same everywhere.

    It lives as long as a batch of rows needs it; `trimmed()` starts anew once it holds `most` words,
    which bounds memory and changes no result.
    """

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most, self._hashes, self._table = most, [], None

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = n = len(self._hashes)
        self._hashes.append(xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")))
        return n

    def trimmed(self) -> WordIds:
        if len(self) > self.most:
            self.clear()
            self._hashes, self._table = [], None
        return self

    def ids(self, tokens: list[str]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def hashes(self, tokens: list[str]):
        """A uint64 hash for each word."""
        import numpy as np

        ids = self.ids(tokens)
        done = 0 if self._table is None else len(self._table)
        if done < len(self._hashes):
            more = np.array(self._hashes[done:], dtype=np.uint64)
            self._table = more if self._table is None else np.concatenate([self._table, more])
        return self._table[ids] if len(ids) else np.empty(0, np.uint64)


def mixed(x):
    """Each uint64 stirred so that all its bits depend on all bits put in (splitmix64's finisher)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes, n: int = 5):
    """Sorted distinct uint64 hashes of all n-word shingles; of the whole text if it has fewer words; none for no word."""
    import numpy as np

    w = word_hashes
    if not len(w):
        return np.empty(0, np.uint64)
    n = min(n, len(w))
    size = len(w) - n + 1
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = mixed(out + w[k : k + size])
    return np.unique(out)
