"""Personal data by fixed patterns and bootstrapped contexts (operator 7).

The fixed patterns find e-mail addresses, IP addresses, card and phone
numbers. They are the seeds. Around each seed, and around every other word
that looks like an identifier (it holds a digit or ``@``), the whole words
beside it make lexical patterns: two to the left, two to the right, one on each
side, and the one on either side together with the identifier's shape (its
runs of letters and of digits). Spark scores the graph of patterns and
instances in rounds:

* a pattern's confidence for a kind is the share of its distinct instances
  that are known to be of that kind, if it has at least ``support`` known ones;
* an unknown instance's confidence is ``1 - prod(1 - confidence)`` over the
  patterns it stands in; from ``accept`` on it is known in the next round.

Patterns and instances are 64-bit hashes from the scan on: no identifier and
none of its surroundings is ever written to the shared folder. Patterns join
instances after partial counts; no pair of instances is formed; Spark's
adaptive joins split a pattern or an instance of very many partners. What was
accepted is added to the spans of every place where it stands in such a
pattern; an instance that is known as several kinds counts as the first.

Fixed patterns, leftmost and non-overlapping for each kind, without retries:
e-mail ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip
``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts up to 255; card
``[0-9]([\\x20-]?[0-9])+``, 14 to 19 digits with a right Luhn sum; phone
``\\+[0-9][\\x20().0-9-]+[0-9]``, 10 to 15 digits.

Defined results: null and empty texts have no spans (the digest of the empty
string); equal rows are reported each; a null ``doc_id`` is kept; an empty
table gives no rows; extra columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, read_table

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
SUPPORT = 5
CONFIDENCE = 0.9
ACCEPT = 0.95
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = frozenset(" \t\n\v\f\r")
_NUMBER = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each ``@`` outwards, so long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def others(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Words with a digit or ``@`` that no span touches."""
    k, done = 0, 0
    spans = sorted((a, b) for a, _, b in spans)
    for m in _MARK.finditer(text):
        if m.start() < done:
            continue
        a, b = m.start(), m.end()
        while a > done and text[a - 1] not in _SPACE:
            a -= 1
        while b < len(text) and text[b] not in _SPACE:
            b += 1
        done = b
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if not any(s < b for s, _ in spans[k : k + 1]):
            yield a, b


def beside(text: str, start: int, end: int, n: int = 2) -> tuple[list[str], list[str]]:
    """Up to ``n`` whole words on each side; the window grows until it holds them."""
    width = 64
    while True:
        left, lo = _WORD.findall(text[max(0, start - width) : start]), max(0, start - width)
        if len(left) > n or lo == 0:  # a window's first word may be cut
            break
        width *= 4
    width = 64
    while True:
        right, hi = _WORD.findall(text[end : end + width]), end + width
        if len(right) > n or hi >= len(text):
            break
        width *= 4
    return left[-n:], right[:n]


def shape(word: str) -> str:
    return _LETTERS.sub("a", _NUMBER.sub("0", word))


def context(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a place; numbers inside words count alike."""
    left, right = ([_NUMBER.sub("0", w.lower()) for w in side] for side in beside(text, start, end))
    form = shape(text[start:end])
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if len(right) == 2:
        out.append(f"_ {right[0]} {right[1]}")
    if left:
        out.append(f"{left[-1]} <{form}>")
    if right:
        out.append(f"<{form}> {right[0]}")
    return out


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_PLACE = "array<struct<start:int,finish:int,kind:int,instance:string,patterns:array<string>>>"
_SPAN = "array<struct<start:int,kind:int,finish:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: counts, base spans, and the places (spans and other identifier-like words) with their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("start", pa.int32()), ("finish", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("finish", pa.int32())]))
        key = uuid.uuid4().hex
        row = 0
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                ids, counts, base, digest, places = [], [], [], [], []
                for t in part.column("text"):
                    text = t.as_py() or ""
                    spans = base_spans(text)
                    near = [(a, b, k) for a, k, b in spans] + [(a, b, None) for a, b in others(text, spans)]
                    ids.append(f"{key}-{row}")
                    row += 1
                    counts.append([sum(s[1] == k for s in spans) for k in range(4)])
                    base.append([{"start": a, "kind": k, "finish": b} for a, k, b in spans])
                    digest.append(hashlib.sha256(_listed(spans).encode()).hexdigest())
                    places.append([{"start": a, "finish": b, "kind": k, "instance": text[a:b], "patterns": context(text, a, b)} for a, b, k in near])
                n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), part.column("doc_id"), *n, pa.array(digest, pa.string()), pa.array(base, span), pa.array(places, place)], ["row_id", "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "places"])

    schema = "row_id string, doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + f", base_sha256 string, base {_SPAN}, places {_PLACE}"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def bootstrap(places: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, kind) and accepted instances (instance, kind) from (instance, kind, patterns)."""
    edges = places.select("kind", "instance", F.explode("patterns").alias("pattern"))
    # one row for each pattern and distinct instance, however often copies repeat it
    edges = materialize(edges.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")), "edges")
    known = edges.filter("kind is not null").select("instance", "kind").distinct()
    patterns = None
    for turn in range(rounds):
        label = known.groupBy("instance").agg(F.min("kind").alias("is_a"))
        marked = edges.select("pattern", "instance").join(label, "instance", "left")
        per_kind = marked.groupBy("pattern", "is_a").agg(F.count(F.lit(1)).alias("n"))
        total = per_kind.groupBy("pattern").agg(F.sum("n").alias("all"), F.max(F.when(F.col("is_a").isNotNull(), F.struct("n", (-F.col("is_a")).alias("less")))).alias("top"))
        score = (F.col("top.n") / F.col("all")).alias("score")
        patterns = materialize(total.filter((F.col("top.n") >= support) & (F.col("top.n") / F.col("all") >= confidence)).select("pattern", (-F.col("top.less")).alias("kind"), score), "patterns")
        if turn + 1 == rounds or patterns.isEmpty():
            break
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        fresh = edges.select("pattern", "instance").join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("sure")).filter(F.col("sure") >= accept)
        known = materialize(known.unionByName(fresh.join(known.select("instance"), "instance", "left_anti").select("instance", "kind")), "known")
    return patterns, known


def hashed(table: DataFrame) -> DataFrame:
    """The rows of ``scan`` with hashes in place of identifiers and their surroundings."""
    places = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["finish"].alias("finish"), p["kind"].alias("kind"), F.xxhash64(p["instance"]).alias("instance"), F.transform(p["patterns"], lambda x: F.xxhash64(x)).alias("patterns")))
    return table.withColumn("places", places)


def find(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each document."""
    table = materialize(hashed(scan(docs)), "scan")
    places = table.select("row_id", F.explode("places").alias("p")).select("row_id", "p.*")
    patterns, known = bootstrap(places.select("kind", "instance", "patterns"))
    loose = places.filter("kind is null").select("row_id", "start", "finish", "instance", F.explode("patterns").alias("pattern"))
    hit = loose.join(patterns.select("pattern", "kind"), "pattern")
    hit = hit.join(known.select("instance", "kind").distinct(), ["instance", "kind"], "left_semi") if not patterns.isEmpty() else hit.limit(0)
    extra = hit.groupBy("row_id", "start", "finish").agg(F.min("kind").alias("kind")).groupBy("row_id").agg(F.collect_list(F.struct("start", "kind", "finish")).alias("extra"))
    out = table.drop("places").join(extra, "row_id", "left")
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.expr(f"cast(array() as {_SPAN})"))))
    name = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["finish"])), ",")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_personal_data": op7_personal_data}
SQL: dict[str, str] = {}
