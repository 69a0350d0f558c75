"""Personal data in texts: fixed rules, and a character tagger that adds what they miss.

The base rules find e-mail addresses, IP addresses, card and phone numbers. They are written so that every
text takes linear time. A bidirectional LSTM with CRF transitions (`tagger`) is trained on windows of the
corpus labelled by base spans. It reads windows of `WINDOW` characters that overlap by half, around every
digit and at sign; a span of any kind has one, so no other window can hold a span. Each window is decoded
alone, then the document's candidates are reconciled: pieces of one kind that overlap in different
windows are joined, conflicts go to the more probable span, and what touches a base span is dropped. Added
spans must pass the same digit checks as base spans.

Base spans always stay. The training sample is bounded by `SAMPLE` windows; reading covers every text whole.
Null texts count as empty and have no spans. Rows are handled alone, so ties and repeated rows play no part.
Without any base span in the corpus there is nothing to learn from and nothing is added. An empty table
gives an empty table; other columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumewatch.llm.frames import documents, name
from plumewatch.llm.tagger import PAD, Tagger, encode
from plumewatch.session import ship_package

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
#: Training windows, at most, and windows that one document may give.
SAMPLE, PER_DOCUMENT, LOTS = 3000, 4, 50
STEPS = 250
#: Mean posterior of an added span.
SURE = 0.9
#: Windows decoded at a time.
BLOCK = 512

_trigger = re.compile("[0-9@]").search
_local = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# a match can only begin where a run of digits does, and gives no digit back
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        # the run before the sign is cut off from the right, so it is read once
        head = text[done:at]
        start = done + len(head.rstrip(_local))
        done = at + 1
        if start < at and (found := _domain(text, at + 1)):
            yield start, found.end()
            done = found.end()
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def valid(kind: int, text: str) -> bool:
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == 1:
        return _small_parts(text)
    if kind == 2:
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind == 0 or 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not _trigger(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    for kind, search in ((1, _ip), (2, _card), (3, _phone)):
        out += [(kind, m.start(), m.end()) for m in search(text) if valid(kind, m.group())]
    return out


# ---------------------------------------------------------------- training windows

def _labels(spans, start: int, end: int) -> np.ndarray:
    """0 outside; 1 + 2 kind at the first character of a span, 2 + 2 kind within it."""
    out = np.zeros(end - start, np.int8)
    for kind, a, b in spans:
        if a < end and b > start:
            out[max(a, start) - start:min(b, end) - start] = 2 + 2 * kind
            if a >= start:
                out[a - start] = 1 + 2 * kind
    return out


def _padded(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WINDOW, PAD, np.int16)
    part = codes[start:start + WINDOW]
    out[:len(part)] = part
    return out


def _windows(batches):
    """At most PER_DOCUMENT labelled windows of each text with digits or at signs."""
    for batch in batches:
        picks, xs, ys = [], [], []
        for item in batch.column(0):
            text = item.as_py()
            if not text or not _trigger(text):
                continue
            spans, codes = base_spans(text), encode(text)
            mark = zlib.crc32(text.encode("utf-8", "replace"))
            centres = [(a + b) // 2 for _, a, b in spans] + [len(text) * (mark % 97) // 97]
            centres += [m.start() for m in re.finditer("[0-9@]+", text)][:8]
            for k in range(min(PER_DOCUMENT, len(centres))):
                pick = zlib.crc32(f"{mark}:{k}".encode())
                centre = centres[(mark + k) % len(centres)]
                start = max(0, min(centre - WINDOW // 2 + pick % 33 - 16, len(text) - WINDOW))
                y = np.zeros(WINDOW, np.int8)
                part = _labels(spans, start, min(len(text), start + WINDOW))
                y[:len(part)] = part
                picks.append(pick)
                xs.append(_padded(codes, start).tobytes())
                ys.append(y.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(picks, pa.int64()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())],
            names=["pick", "x", "y"])


def train(df: DataFrame, text: str = "text", steps: int = STEPS, sample: int = SAMPLE) -> Tagger | None:
    """A tagger fitted on the windows with the lowest hashes; None if no window has a span.

    The lowest ones are found in `LOTS` lots, so that no task and not the driver sees those of all tasks.
    """
    ship_package(df.sparkSession)
    lot = Window.partitionBy(F.pmod("pick", F.lit(LOTS))).orderBy("pick", "x")
    rows = df.select(F.col(name(text)).alias("text")).mapInArrow(
        _windows, "pick long, x binary, y binary").withColumn("place", F.row_number().over(lot)).where(
        F.col("place") <= -(-sample // LOTS)).select("pick", "x", "y").collect()
    if not rows:
        return None
    rows.sort()
    x = np.frombuffer(b"".join(r.x for r in rows), np.int16).reshape(-1, WINDOW)
    y = np.frombuffer(b"".join(r.y for r in rows), np.int8).reshape(-1, WINDOW).astype(np.int64)
    if not y.any():
        return None
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.train(x, y, steps)
    return tagger


# ---------------------------------------------------------------- reading

def _read(path: np.ndarray, chance: np.ndarray):
    """(kind, start, end, score) of the spans in one window's labels."""
    at = 0
    while at < len(path):
        if path[at] == 0:
            at += 1
            continue
        kind, begin = (path[at] - 1) // 2, at
        at += 1
        while at < len(path) and path[at] == 2 + 2 * kind:
            at += 1
        yield int(kind), begin, at, float(chance[begin:at].mean())


def reconcile(text: str, base, candidates) -> list[tuple[int, int, int]]:
    """Added spans of one document from the candidates (kind, start, end, score) of all its windows."""
    joined: list[list] = []
    for kind, a, b, score in sorted(candidates):
        if joined and joined[-1][0] == kind and a < joined[-1][2]:
            joined[-1][2] = max(b, joined[-1][2])
            joined[-1][3] = max(score, joined[-1][3])
        else:
            joined.append([kind, a, b, score])
    # base spans sorted by start; the furthest end so far finds overlaps
    starts = sorted((a, b) for _, a, b in base)
    begins = np.array([a for a, _ in starts], np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in starts], np.int64)) if starts else begins
    good = []
    for kind, a, b, score in joined:
        before = int(np.searchsorted(begins, b)) - 1
        if score < SURE or b - a < 6 or (before >= 0 and ends[before] > a):
            continue
        found = text[a:b]
        if kind == 0 and not re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", found):
            continue
        if kind == 1 and not re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", found):
            continue
        if _trigger(found) and valid(kind, found):
            good.append((score * (b - a), kind, a, b))
    taken: list[tuple[int, int, int]] = []
    for _, kind, a, b in sorted(good, key=lambda s: (-s[0], s[2])):
        # taken spans are apart, so only the two neighbours can be in the way
        i = bisect_left(taken, (a, b, kind))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b, kind))
    return sorted((kind, a, b) for a, b, kind in taken)


def added_spans(tagger: Tagger | None, texts: list[str], bases: list[list]) -> list[list]:
    out: list[list] = [[] for _ in texts]
    if tagger is None:
        return out
    found: dict[int, list] = {}
    held: list[tuple[int, int]] = []
    rows: list[np.ndarray] = []

    def flush():
        if not rows:
            return
        path, chance = tagger.decode(np.stack(rows))
        for (i, start), p, c in zip(held, path, chance):
            size = min(WINDOW, len(texts[i]) - start)
            if p[:size].any():
                found.setdefault(i, []).extend(
                    (k, start + a, start + b, s) for k, a, b, s in _read(p[:size], c[:size]))
        held.clear()
        rows.clear()

    for i, text in enumerate(texts):
        if not text or not _trigger(text):
            continue
        codes = encode(text)
        places = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64)) // STRIDE
        for k in np.unique(np.concatenate([places, np.maximum(places - 1, 0)])).tolist():
            held.append((i, k * STRIDE))
            rows.append(_padded(codes, k * STRIDE))
            if len(rows) >= BLOCK:
                flush()
    flush()
    for i, candidates in found.items():
        out[i] = reconcile(texts[i], bases[i], candidates)
    return out


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("stop", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def redacted(text: str, spans) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first one names it."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(df: DataFrame, tagger: Tagger | None, text: str = "text", out: str = "pii",
         clean: str | None = None) -> DataFrame:
    """Adds the array of spans (base ones first, by kind and start) and, if named, the redacted text.

    The text column goes unless `clean` has its name. One pass, no shuffle.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    kept = [c for c in df.columns if c not in (text, out, clean)]

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = added_spans(shared.value, texts, bases)
            spans = [[{"kind": KINDS[k], "start": a, "stop": b, "base": own}
                      for own, some in ((True, base), (False, new)) for k, a, b in some]
                     for base, new in zip(bases, more)]
            arrays = [batch.column(names.index(c)) for c in kept] + [pa.array(spans, pa.list_(pa.struct([
                ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                ("base", pa.bool_())])))]
            if clean:
                arrays.append(pa.array([redacted(t, b + m) for t, b, m in zip(texts, bases, more)],
                                       pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, out] + [clean] * bool(clean))

    fields = [*df.select(*[name(c) for c in kept]).schema.fields, T.StructField(out, SPANS)]
    if clean:
        fields.append(T.StructField(clean, T.StringType()))
    return df.mapInArrow(run, T.StructType(fields))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op7_char_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find(docs, train(docs))
    base = F.filter("pii", lambda s: s["base"])
    # added spans take their place by kind and start
    place = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(
        F.array_position(place, s["kind"]).alias("rank"), s["start"].alias("start"),
        s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(ordered).alias("spans"))
