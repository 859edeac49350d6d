"""Personal data: base patterns and information-theoretic sanitisation.

Base spans (email, ip, card, phone) are the protected entities; each is reported. A term beside an entity (a word of four or more
letters within ``reach`` words of it) can reveal it. Over the whole corpus, with N documents, c(e) that hold an entity,
c(t) that hold a term and c(e, t) that hold the term beside the entity, the term discloses
PMI(e, t) = log2(N c(e, t) / (c(e) c(t))) of the entity's information IC(e) = log2(N / c(e)). A term whose share PMI / IC is at least ``remove``
is marked for removal (kind ``term_remove``), one at ``generalise`` or more for generalisation (``term_generalise``), in the places where it stands beside the entity; elsewhere
it is harmless. Only pairs seen in ``support`` different surroundings count, so copies of one passage prove nothing.

Patterns follow leftmost non-overlapping matching without retries; the forms used here start only where such a match can
start, so that long runs stay linear. Positions are code points. Defined cases: a null or empty text has no spans; repeated
rows count once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_of

KINDS = ("email", "ip", "card", "phone", "term_remove", "term_generalise")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^ \t\n\r\x0b\f]+")
_MARKS = ".,;:!?\"'()"
_TERM = re.compile(r"[^\W\d_]{4,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", at + 1)


def _byte(digits: str) -> bool:
    """At most 255; runs of any length are never made a number whole."""
    d = digits.lstrip("0")
    return len(d) < 3 or (len(d) == 3 and d <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def render(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _tokens(text: str, spans) -> list[tuple[int, int, str]]:
    """(start, end, word) between entities: words end at ASCII white space and at entities, here and wherever words are counted."""
    out, at = [], 0
    for a, _, b in [*spans, (len(text), 0, len(text))]:
        if a > at:
            out += [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, at, a)]
        at = max(at, b)
    return out


def _words(tokens) -> list[str]:
    return sorted({w.strip(_MARKS).lower() for _, _, w in tokens})


def _entity(text: str, span) -> str:
    return hashlib.md5(f"{span[1]}:{text[span[0] : span[2]]}".encode("utf-8", "surrogatepass")).hexdigest()


def _beside(text: str, spans, tokens, reach: int) -> Iterator[tuple[str, str, str, int, int]]:
    """(entity, term, surroundings, start, end) for terms within reach words of an entity and outside all spans."""
    starts, ends = [x for x, _, _ in tokens], [y for _, y, _ in tokens]
    for a, k, b in spans:
        last, first = bisect_right(ends, a), bisect_left(starts, b)
        around = tokens[max(0, last - reach) : last] + tokens[first : first + reach]
        place = hashlib.md5(" ".join(w for _, _, w in around).encode("utf-8", "surrogatepass")).hexdigest()
        entity = _entity(text, (a, k, b))
        for at, _, word in around:
            m = _TERM.fullmatch(word.strip(_MARKS))
            if m:
                start = at + word.find(m[0])
                yield entity, m[0].lower(), place, start, start + len(m[0])


SCANNED = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, words array<string>, entities array<string>, near array<struct<entity:string,term:string,place:string,start:int,end:int>>"


def _scan(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    near_type = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("place", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    types = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), near_type]
    names = [c.split()[0] for c in SCANNED.split(", ", 9)]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            text = text.as_py() or ""
            spans = base_spans(text)
            kinds = [k for _, k, _ in spans]
            tokens = _tokens(text, spans) if spans else []
            near = [dict(zip(("entity", "term", "place", "start", "end"), x)) for x in _beside(text, spans, tokens, reach)]
            entities = sorted({_entity(text, x) for x in spans})
            for c, v in zip(cols, (row, doc_id, *map(kinds.count, range(4)), render(spans), _words(tokens), entities, near)):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def scan(docs: DataFrame, reach: int = 6) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scan(it, reach), SCANNED)


def _all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_words(_tokens(t, base_spans(t))) for t in texts], pa.list_(pa.string()))], ["words"])


def disclosures(docs: DataFrame, holders: DataFrame, near: DataFrame, n: int, support: int = 3, generalise: float = 0.7, remove: float = 0.9) -> DataFrame:
    """holders: (words, entities) of the documents that hold an entity; near: (row, entity, term, place); n: documents. (entity, term, share, kind) of the
    pairs that disclose enough; frequencies are over all of docs.

    A term's documents are at least those that have it beside an entity, and at least those of the holders that have it. Either bounds its
    share from above. Only terms that can still pass are then counted in all documents: a small stored table, which Spark may broadcast by its size.
    """
    pairs = near.select("entity", "term", "place").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") >= support)
    both = near.join(pairs.select("entity", "term"), ["entity", "term"], "left_semi").select("entity", "term", "row").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c_et"))
    holds = holders.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("c_e")).where(F.col("c_e") < n)
    beside = near.select("term", "row").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("c_t"))
    share = F.log2(F.lit(n) * F.col("c_et") / (F.col("c_e") * F.greatest("c_t", "c_et"))) / F.log2(F.lit(n) / F.col("c_e"))
    hopeful = stored(both.join(holds, "entity").join(beside, "term").where(share >= generalise).drop("c_t"), "hopeful")
    first = stored(hopeful.select("term").distinct(), "terms")
    held = holders.select(F.explode("words").alias("term")).join(first, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("c_t"))
    hopeful = stored(hopeful.join(held, "term").where(share >= generalise).drop("c_t"), "hopeful")
    terms = stored(hopeful.select("term").distinct(), "terms")
    every = docs.select(text_of(docs).alias("text")).mapInArrow(_all_words, "words array<string>")
    c_t = every.select(F.explode("words").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("c_t"))
    scored = hopeful.join(c_t, "term").withColumn("share", share).where(F.col("share") >= generalise)
    return scored.select("entity", "term", "share", F.when(F.col("share") >= remove, "term_remove").otherwise("term_generalise").alias("kind"))


def find_personal_data(docs: DataFrame, reach: int = 6, support: int = 3, generalise: float = 0.7, remove: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms of each document (doc_id, text)."""
    scanned = stored(scan(docs, reach), "pii")
    some = F.size("near") > 0
    near = scanned.where(some).select("row", F.explode("near").alias("x")).select("row", "x.*")
    near = stored(near, "beside")
    found = near.join(disclosures(docs, scanned.where(F.size("entities") > 0).select("words", "entities"), near, scanned.count(), support, generalise, remove), ["entity", "term"])
    extra = found.select("row", "start", "end", "kind").distinct().groupBy("row", "start", "end").agg(F.max("kind").alias("kind"))
    rank = F.when(F.col("kind") == "term_remove", 4).otherwise(5)
    extra = extra.groupBy("row").agg(F.collect_list(F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("said"))).alias("extra"))
    out = scanned.drop("words", "entities", "near").join(extra, "row", "left")
    said = F.filter(F.split("base", ","), lambda x: x != "")
    based = F.transform(said, lambda x: F.struct(F.element_at(F.split(x, ":"), 2).cast("int").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.element_at(F.split(x, ":"), 1)).cast("int").alias("rank"), x.alias("said")))
    every = F.array_sort(F.concat(based, F.coalesce("extra", F.array().cast("array<struct<start:int,rank:int,said:string>>"))))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
        F.array_join(F.transform(every, lambda x: x["said"]), ",").alias("spans"), F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_terms"),
    )


def sanitise(text: str, spans: str) -> str:
    """The text with its spans replaced: removed terms vanish, generalised ones become [TERM], entities their kind."""
    out = text
    parts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    kept, at = [], 0
    for a, b, k in parts:
        if b <= at:
            continue
        kept += [out[at : max(a, at)], {"term_remove": "", "term_generalise": "[TERM]"}.get(k, f"[{k.upper()}]")]
        at = b
    return "".join([*kept, out[at:]])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
