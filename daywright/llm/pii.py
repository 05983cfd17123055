"""Personal data: base patterns, and identifiers that contexts give away.

Base matches (email, ip, card, phone) are seeds. Their surroundings, two words to the left or one on
each side, are lexical patterns; so are those of every other token that looks like an identifier.
Patterns and instances form a graph, which Spark scores in turns: a pattern is as sure as the share
of its instances known to be of a kind, an instance as sure as its patterns make it together. Tokens
in the context of a sure pattern become spans of the pattern's kind; base spans stay as they are.

Texts are read once; what is kept of them are places and hashes of contexts and instances.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daywright.llm.common import col, stored

KINDS = ("email", "ip", "card", "phone")

#: Rounds of scoring; different instances that a pattern needs; its least certainty, and an instance's.
ROUNDS, MIN_INSTANCES, SURE_PATTERN, SURE_INSTANCE = 3, 4, 0.75, 0.75

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried once, from its start: later starts meet the same end.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*")
_EDGE = ".,;:!?()[]{}<>\"'|*#$%&"

#: Characters of context looked at on either side, and the longest token that can be an identifier.
_REACH, _LONGEST = 200, 100


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every base match, in order; code points, end exclusive."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def contexts(text: str, start: int, end: int) -> list[int]:
    """Hashes of the patterns around a place; none where the text has too few words there."""
    left = text[max(0, start - _REACH) : start].lower().split()
    right = text[end : end + _REACH].lower().split()
    # A word at the edge of what is looked at may be cut: it isn't used.
    if start > _REACH and left:
        left = left[1:]
    out = []
    if len(left) >= 2:
        out.append(_hash("left", left[-2].strip(_EDGE), left[-1]))
    if left and right:
        out.append(_hash("both", left[-1], right[0].strip(_EDGE)))
    return out


def identifiers(text: str, known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with two digits or more, five characters or more, outside the known spans."""
    k = 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        if len(token) > _LONGEST:
            continue
        core = token.strip(_EDGE)
        start = m.start() + token.index(core) if core else m.start()
        end = start + len(core)
        if len(core) < 5 or sum(c.isdigit() for c in core) < 2:
            continue
        while k < len(known) and known[k][2] <= start and all(x[2] <= start for x in known[k : k + 2]):
            k += 1
        if not any(s < end and start < e for s, _, e in known[max(0, k - 4) : k + 8]):
            yield start, end


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _read(batches: Iterator) -> Iterator:
    """A row a document: its base spans, and the candidates with their contexts; rows are numbered."""
    import pyarrow as pa
    from pyspark import TaskContext

    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    seen = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        spans, candidates = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            spans.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in base])
            found = [(s, e, k) for s, k, e in base]
            found += [(s, e, None) for s, e in identifiers(text, base)] if _DIGIT.search(text) else []
            candidates.append(
                [{"start": s, "end": e, "kind": k, "instance": _hash("instance", text[s:e]), "patterns": contexts(text, s, e)} for s, e, k in found]
            )
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(row, row + n), pa.int64()), batch.column("doc_id"), pa.array(spans, pa.list_(span)), pa.array(candidates, pa.list_(seen))],
            ["row", "doc_id", "base", "candidates"],
        )
        row += n


def sure_patterns(
    edges: DataFrame, rounds: int = ROUNDS, min_instances: int = MIN_INSTANCES, sure_pattern: float = SURE_PATTERN, sure_instance: float = SURE_INSTANCE
) -> DataFrame:
    """(pattern, kind) of the patterns that are sure after the last round, from edges (pattern, instance, kind or null).

    Sums only, with partial sums before each shuffle: a pattern or an instance with very many edges is
    no hot task. Every round is written out.
    """
    spark = edges.sparkSession
    seeds = edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("sure", F.lit(1.0))
    seeds = stored(seeds, "seeds")
    edges = stored(edges.select("pattern", "instance").distinct(), "edges")
    known, patterns = seeds, None
    for n in range(rounds):
        scored = edges.join(known, "instance", "left")
        shares = scored.groupBy("pattern").agg(
            F.count("*").alias("n"), *[F.sum(F.when(F.col("kind") == k, F.col("sure")).otherwise(0.0)).alias(f"k{k}") for k in range(len(KINDS))]
        )
        best = F.greatest(*[F.struct((F.col(f"k{k}") / F.col("n")).alias("sure"), F.lit(k).alias("kind")) for k in range(len(KINDS))])
        patterns = shares.where(F.col("n") >= min_instances).select("pattern", best.alias("b")).select("pattern", "b.*").where(F.col("sure") >= sure_pattern)
        patterns = stored(patterns, "patterns")
        if n == rounds - 1 or patterns.isEmpty():
            break
        doubt = F.log(F.greatest(1 - F.col("sure"), F.lit(1e-6)))
        told = edges.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(doubt))).alias("sure"))
        told = told.groupBy("instance").agg(F.max(F.struct("sure", "kind")).alias("b")).select("instance", "b.kind", "b.sure").where(F.col("sure") >= sure_instance)
        known = stored(seeds.unionByName(told.join(seeds.select("instance"), "instance", "left_anti").select("instance", "kind", "sure")), "known")
    return patterns.select("pattern", "kind") if patterns is not None else spark.createDataFrame([], "pattern long, kind int")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, all spans, and the number that contexts added.

    Null texts count as empty; repeated rows are read one by one (they add no weight: edges are distinct).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = "array<struct<start:int,end:int,kind:int,instance:bigint,patterns:array<bigint>>>"
    schema = f"row bigint, doc_id {kind}, base array<struct<start:int,kind:int,end:int>>, candidates {seen}"
    rows = stored(docs.select(col("doc_id"), col("text")).mapInArrow(_read, schema), "spans")
    places = rows.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    edges = places.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    patterns = sure_patterns(edges)
    new = places.where("kind is null").select("row", "start", "end", F.explode("patterns").alias("pattern")).join(patterns, "pattern")
    new = new.groupBy("row", "start", "end").agg(F.min("kind").alias("kind"))
    added = new.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    out = rows.select("row", "doc_id", "base").join(added, "row", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    of = lambda kind: lambda s: F.when(s["kind"] == kind, 1)
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")
    return out.select(
        "doc_id",
        *[F.size(F.array_compact(F.transform("base", of(k)))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.sort_array(F.concat("base", F.coalesce("added", none)))).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )
