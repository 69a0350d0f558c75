"""Language identification in two levels, learned from labelled documents.

Texts become byte n-gram counts (three and four bytes, hashed to `FEATURES` cells, square roots, length
one). A linear support vector machine for each language family, one against the rest, names the family;
machines for each pair of its languages then vote, which keeps closely related languages apart.

Families of common language codes are fixed knowledge; any other label is a family of its own. Training
takes at most `ROWS` documents, shared evenly by the labels and picked by a hash of id and label; their
features are computed by the workers from whole texts. With one label that one is predicted, without any
the answer is always `und`.

A text that is null or has no letter is `und` with score 0. Repeated rows get equal answers. Predictions use
the text alone. An empty table gives an empty table; other columns may have any names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumewatch.llm.frames import documents, fresh, name, packed
from plumewatch.session import ship_package

FEATURES = 8192
#: Documents that the machines are fitted on, at most.
ROWS = 2000
#: Score from which a prediction replaces the given language.
CERTAIN = 0.9
#: Characters turned into features at a time.
BLOCK = 1 << 20
UNKNOWN = "und"

#: Families of common language codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr gu pa ur ne",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
    "malayic": "id ms",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_letter = regex.compile(r"\p{L}").search
#: Bytes of a lower-cased text; what is neither an ASCII letter nor part of a longer character is a space.
_KEPT = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def features(text: str) -> np.ndarray:
    """Hashed n-gram counts of the whole text, as square roots, of length one."""
    counts = np.zeros(FEATURES, np.int64)
    for at in range(0, len(text), BLOCK):
        raw = text[max(0, at - 3):at + BLOCK].lower().encode("utf-8", "replace")
        b = _KEPT[np.frombuffer(b" " + raw + b" ", np.uint8)]
        if len(b) < 4:
            b = np.concatenate([b, np.full(4 - len(b), 32, np.uint32)])
        three = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(
            0xC2B2AE3D)
        four = three[:-1] + b[3:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
        shift = np.uint32(32 - FEATURES.bit_length() + 1)
        counts += np.bincount(three >> shift, minlength=FEATURES)
        counts += np.bincount((four ^ four >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> shift,
                              minlength=FEATURES)
    row = np.sqrt(counts).astype(np.float32)
    return row / np.sqrt(counts.sum(dtype=np.float64)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 200, penalty: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge, class-balanced).

    y is 1 or -1, and 0 for rows that play no part, so that no part of x is copied. Gradient descent with
    momentum on the whole sample; the result depends on the rows alone.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    share = np.where(y == 0, 0, share).astype(np.float32)
    w, pull = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
    y = y.astype(np.float32)
    for _ in range(rounds):
        short = share * y * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
        slope = penalty * w - 2 * np.append(short @ x, short.sum())
        pull = 0.9 * pull - 0.2 * slope
        w = w + pull
    return w.astype(np.float32)


class Model:
    """Machines of both levels."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.labels = sorted(set(labels))
        y = np.array(labels)
        family = {label: FAMILY_OF.get(label.split("-")[0].lower(), label) for label in self.labels}
        self.families = sorted(set(family.values()))
        self.members = {f: [a for a in self.labels if family[a] == f] for f in self.families}
        of = np.array([family[a] for a in labels]) if labels else np.array([], str)
        columns = [machine(x, np.where(of == f, 1, -1)) for f in self.families] if len(
            self.families) > 1 else []
        self.pairs: dict[str, list[tuple[int, int, int]]] = {f: [] for f in self.families}
        for f in self.families:
            for (i, a), (j, b) in combinations(enumerate(self.members[f]), 2):
                self.pairs[f].append((i, j, len(columns)))
                columns.append(machine(x, np.where(y == a, 1, np.where(y == b, -1, 0))))
        self.weights = np.stack(columns, axis=1) if columns else np.zeros((FEATURES + 1, 0), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, scores = [], []
        for text in texts:
            if text is None or not self.labels or not _letter(text):
                out.append(UNKNOWN)
                scores.append(0.0)
                continue
            margins = features(text) @ self.weights[:-1] + self.weights[-1]
            family, score = self.families[0], 1.0
            if len(self.families) > 1:
                first = margins[:len(self.families)]
                chance = np.exp(4 * (first - first.max()))
                family, score = self.families[int(first.argmax())], float(1 / chance.sum())
            members = self.members[family]
            if len(members) > 1:
                votes = np.zeros(len(members))
                for i, j, k in self.pairs[family]:
                    side = 1 / (1 + np.exp(-4.0 * float(margins[k])))
                    # whole votes decide, soft ones settle ties and give the score
                    votes[i] += (side >= 0.5) + side * 1e-3
                    votes[j] += (side < 0.5) + (1 - side) * 1e-3
                best = int(votes.argmax())
                sides = [1 / (1 + np.exp(-4.0 * float(margins[k]) * (1 if i == best else -1)))
                         for i, j, k in self.pairs[family] if best in (i, j)]
                score *= float(min(sides))
                out.append(members[best])
            else:
                out.append(members[0])
            scores.append(min(1.0, max(0.0, score)))
        return out, scores


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id",
        rows: int = ROWS) -> Model:
    """A model of the labelled rows; rows without label or letter teach nothing."""
    ship_package(labelled.sparkSession)
    known = labelled.select(
        F.col(name(lang)).alias("lang"), F.pmod(F.xxhash64(name(row_id), name(lang)), F.lit(1 << 31)).alias("pick"),
        F.col(name(text)).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    # one short row for each label
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    if not counts:
        return Model(np.zeros((0, FEATURES), np.float32), [])
    each = max(1, rows // len(counts))
    # the share of hashes that holds about twice the rows needed, then the lowest hashes of them
    upto = F.create_map(*[F.lit(v) for r in counts for v in (
        r.lang, int(min(1.0, 2 * each / r["count"] + 20 / r["count"]) * (1 << 31)))])
    # equal hashes are repeated rows, of which one is enough
    near = known.where(F.col("pick") <= upto[F.col("lang")]).groupBy("lang", "pick").agg(
        F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            langs, picks, texts = (batch.column(i).to_pylist() for i in range(3))
            some = [i for i, t in enumerate(texts) if _letter(t)]
            yield pa.RecordBatch.from_arrays([
                pa.array([langs[i] for i in some], pa.string()),
                pa.array([picks[i] for i in some], pa.int64()),
                pa.array([features(texts[i]).astype(np.float16).tobytes() for i in some], pa.binary())],
                names=["lang", "pick", "row"])

    # at most `each` rows of a label, 16 KB each, reach the driver
    lowest = Window.partitionBy("lang").orderBy("pick", "row")
    found = near.mapInArrow(run, "lang string, pick long, row binary").withColumn(
        "place", F.row_number().over(lowest)).where(F.col("place") <= each).orderBy(
        "lang", "place").select("lang", "row").toArrow()
    x = np.zeros((found.num_rows, FEATURES), np.float32)
    for i, row in enumerate(found.column("row")):
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    return Model(x, found.column("lang").to_pylist())


def predict(df: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """Adds prediction and score to the rows; one pass, the text column stays where it is."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (lang_out, score_out)]

    def run(batches):
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            names = batch.schema.names
            langs, scores = shared.value.predict(batch.column(names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in kept]
                + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*kept, lang_out, score_out])

    schema = df.select(*[name(c) for c in kept], F.lit("").alias(lang_out),
                       F.lit(0.0).alias(score_out)).schema
    return df.mapInArrow(run, schema)


def held_out(row_id: str):
    """The third of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(name(row_id)).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = fit(df.where(~held_out(row_id)), text, lang, row_id)
    rows = df.select(F.col(name(row_id)).alias("doc_id"), held_out(row_id).alias("held_out"),
                     F.col(name(text)).alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def known_language(df: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id",
                   ) -> DataFrame:
    """The rows whose text is in a language, with their own columns; `und` rows go.

    The language column takes the predicted language where it is null or the score is at least `CERTAIN`.
    """
    model = fit(df.where(~held_out(row_id)), text, lang, row_id)
    row, content, found, score = (fresh(n) for n in ("row", "text", "lang", "score"))
    rows = df.select(packed(df).alias(row), F.col(name(text)).alias(content))
    known = predict(rows, model, content, found, score).where(F.col(found) != UNKNOWN)
    own = F.col(row).getField(lang)
    named = F.when(own.isNull() | (F.col(score) >= CERTAIN), F.col(found)).otherwise(own)
    return known.select(*[named.alias(c) if c == lang else F.col(row).getField(c).alias(c) for c in df.columns])


def op9_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
