"""Problem 1: quantities recorded in different units and scales, brought to the base unit of their kind.

Every quantity's unit entry is read, and the quantity is found in its sentence. Where the entry names no unit, a random forest
says how likely each candidate is to be the unit: the one that stands with the number, those of the neighbouring quantities, and those
that the source and the category (the concept that the sentence names) use most. It goes by how often the source, the category,
both together and numbers of that magnitude have the unit, counted over all quantities whose entry names one. It is trained on a bounded sample
of these, with the unit hidden, and its confidence is calibrated on held-out ones by isotonic regression. Confident predictions are
converted; uncertain ones, and those that the sentence contradicts, go to review.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quantmill.functions.unit_text import FOREIGN, MISSING, Lexicon, align
from quantmill.session import cut

#: Bound of the labelled sample that the classifier is fitted on, and the part of it held out for calibration.
SAMPLE, HELD_OUT = 10_000, 0.5
#: Calibrated confidence from which a prediction is converted.
CONFIDENT = 0.9
TREES, DEPTH = 20, 8
#: Units and concepts are reference lists of bounded size; checked.
MAX_REFERENCE = 10_000
#: Candidates that a source, a category, or both together put up.
USUAL = 3
FEATURES = ("is_stated", "other_stated", "is_neighbour", "source_share", "concept_share", "both_share", "magnitude_share", "magnitude", "whole")


def _reference(df: DataFrame, what: str) -> list:
    rows = df.limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"more than {MAX_REFERENCE} {what}")
    return rows


def _finder(concepts: list[str]):
    """A function from a lower-cased text to the number of the first concept that it names, or -1."""
    try:
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, c in enumerate(concepts):
            a.add_word(c, i)
        if not concepts:
            return lambda s: -1
        a.make_automaton()
        return lambda s: next((i for _, i in a.iter(s)), -1)
    except ImportError:
        return lambda s: next((i for i, c in enumerate(concepts) if c in s), -1)


def read_quantities(collection: DataFrame, lexicon: Lexicon, concepts: list[str]) -> DataFrame:
    """One row per quantity of the last delivery of every record: its entry's unit, what its sentence states, and its neighbours."""
    rows = collection.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("ingested_at").cast("timestamp").alias("at"), F.col("source").alias("source"),
        F.lower("sentence").alias("sentence"), F.col("values").cast("array<double>").alias("values"), F.col("units").cast("array<string>").alias("units"),
    ).where("doc_id is not null")
    parts = collection.sparkSession.sparkContext.broadcast((lexicon, concepts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, names = parts.value
        find = _finder(names)
        for b in batches:
            value, unit, stated, lacks, blind, neighbour = ([] for _ in range(6))
            concept, ends = [], [0]
            for s, vs, us in zip(b.column("sentence").to_pylist(), b.column("values").to_pylist(), b.column("units").to_pylist()):
                vs = vs or []
                us = (us or [])[: len(vs)]
                entries = [lex.entry(u) for u in us] + [(MISSING, 1.0)] * (len(vs) - len(us))
                seen = lex.read(s) if vs else ([], None)
                hidden = [(MISSING, 1.0)] * len(vs)
                found = align(seen, vs, entries)
                # what the sentence states when the entries are not known, for the training
                unaided = align(seen, vs, hidden) if any(e[0] != MISSING for e in entries) else found
                for p, (v, e, x, y) in enumerate(zip(vs, entries, found, unaided)):
                    value.append(v)
                    unit.append(e[0])
                    stated.append(x.unit)
                    lacks.append(x.missing_scale)
                    blind.append(y.unit)
                    neighbour.append(next((o[0] for q, o in enumerate(entries) if q != p and o[0] >= 0), FOREIGN))
                concept.append(find(s) if s and vs else FOREIGN)
                ends.append(len(value))
            fields = [pa.array(value, pa.float64()), pa.array(unit, pa.int32()), pa.array(stated, pa.int32()), pa.array(lacks, pa.float64()), pa.array(blind, pa.int32()), pa.array(neighbour, pa.int32())]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["value", "unit", "stated", "lacks", "blind", "neighbour"]))
            yield pa.record_batch([b.column("doc_id"), b.column("at"), b.column("source"), pa.array(concept, pa.int32()), found], ["doc_id", "at", "source", "concept", "found"])

    read = rows.mapInArrow(run, "doc_id long, at timestamp, source string, concept int, found array<struct<value:double,unit:int,stated:int,lacks:double,blind:int,neighbour:int>>")
    # of deliveries of one time the largest, so that the order of rows cannot decide
    last = read.groupBy("doc_id").agg(F.max(F.struct("at", "source", "concept", "found")).alias("x"))
    each = last.select("doc_id", "x.source", "x.concept", F.posexplode("x.found").alias("pos", "q"))
    return each.select("doc_id", "source", "concept", "pos", "q.*").where("value is not null and not isnan(value)")


#: How the habits of the data are counted: by name, the columns that they go by.
_HABITS = {"source": ["source"], "concept": ["concept"], "both": ["source", "concept"], "magnitude": ["size"]}


def _size() -> Column:
    return F.when(F.col("value") == 0, -30).otherwise(F.floor(F.log10(F.abs("value")))).cast("int")


class Habits:
    """How often each unit occurs with each source, category, both, and magnitude."""

    @staticmethod
    def counts(known: DataFrame) -> DataFrame:
        """(source, concept, size, unit, half, n) of all quantities whose entry names a unit, materialised."""
        by = [F.coalesce("source", F.lit("")).alias("source"), "concept", _size().alias("size"), "unit", _half().alias("half")]
        return cut(known.groupBy(*by).agg(F.count("*").alias("n")))

    def __init__(self, each: DataFrame) -> None:
        self.tables = {}
        for name, by in _HABITS.items():
            units = each.groupBy(*by, "unit").agg(F.sum("n").alias("n"))
            listed = F.map_from_entries(F.collect_list(F.struct("unit", "n"))).alias(f"{name}_units")  # at most as many as there are units
            usual = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("n", "unit")), asc=False), 1, USUAL), lambda x: x["unit"]).alias(f"{name}_usual")
            self.tables[name] = units.groupBy(*by).agg(listed, F.sum("n").alias(f"{name}_n"), usual)

    def candidates(self, rows: DataFrame, stated: str) -> DataFrame:
        """One row per candidate unit of each quantity, with ``features``."""
        out = rows.withColumns({"source": F.coalesce("source", F.lit("")), "size": _size()})
        for name, by in _HABITS.items():
            out = out.join(self.tables[name], by, "left")
        usual = [F.coalesce(f"{name}_usual", F.array().cast("array<int>")) for name in ("source", "concept", "both")]
        units = F.filter(F.array_distinct(F.concat(F.array(stated, "neighbour"), *usual)), lambda u: u >= 0)
        out = out.withColumn("candidate", F.explode(units))

        def share(name: str) -> Column:
            n = F.coalesce(F.try_element_at(f"{name}_units", F.col("candidate")), F.lit(0))
            return (n + 0.01) / (F.coalesce(f"{name}_n", F.lit(0)) + 1.0)

        is_stated = F.col(stated) == F.col("candidate")
        values = {
            "is_stated": is_stated, "other_stated": (F.col(stated) >= 0) & ~is_stated, "is_neighbour": F.col("neighbour") == F.col("candidate"),
            **{f"{name}_share": share(name) for name in _HABITS}, "magnitude": F.col("size"), "whole": F.col("value") == F.floor("value"),
        }
        return out.select(*rows.columns, "candidate", F.array(*[values[f].cast("double") for f in FEATURES]).alias("features"))


def _half() -> Column:
    return F.pmod(F.xxhash64("pos", "doc_id"), F.lit(2)).cast("int")


class UnitClassifier:
    """A random forest over candidate units with calibrated confidence. With fewer than two labelled units it predicts nothing.

    It is trained on quantities of one half against the habits of the other, as a quantity must not be among those that its features are
    counted from; predictions go by the habits of both halves."""

    def __init__(self, known: DataFrame) -> None:
        """``known``: quantities with a unit. SAMPLE of them, those of least hash, are used; HELD_OUT of these calibrate."""
        spark = known.sparkSession
        each = Habits.counts(known)
        self.model, self.habits = None, Habits(each)
        known = known.where(_half() == 0)
        hashed = known.withColumn("h", F.xxhash64("doc_id", "pos"))
        # only about as many rows as are wanted are sorted, whatever the number of tasks
        share = min(1.0, 1.25 * SAMPLE / max(1, known.count()))
        hashed = hashed.where(F.col("h") <= min(2**63 - 1, int(-(2**63) + share * 2**64)))
        drawn = hashed.orderBy("h", "doc_id", "pos").limit(SAMPLE).withColumn("own", F.col("unit"))
        # each once with what its sentence states, and once without, as for quantities whose sentence is silent
        drawn = drawn.withColumn("silent", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("blind", F.when(F.col("silent") == 1, FOREIGN).otherwise(F.col("blind")))
        rows = Habits(each.where("half = 1")).candidates(drawn.select("h", "doc_id", "pos", "silent", "value", "source", "concept", "blind", "neighbour", "own"), "blind").select("h", "doc_id", "pos", "silent", "blind", "own", "candidate", "features").toArrow().to_pandas()
        if rows["own"].nunique() < 2:
            return
        rows = rows.sort_values(["h", "doc_id", "pos", "silent", "candidate"], ignore_index=True)
        rows["label"] = (rows["own"] == rows["candidate"]).astype(float)
        if rows["label"].nunique() < 2:
            return
        quantity = rows.groupby(["h", "doc_id", "pos"], sort=False).ngroup()
        held = quantity < max(1, int((quantity.max() + 1) * HELD_OUT))
        columns = ["doc_id", "pos", "silent", "blind", "own", "candidate", "features", "label"]
        frame = lambda part: spark.createDataFrame(pa.Table.from_pandas(part[columns], preserve_index=False)).coalesce(1).withColumn("features", array_to_vector("features"))
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.7", subsamplingRate=0.7, seed=11)
        model = forest.fit(frame(rows[~held])) if (~held).any() and rows.loc[~held, "label"].nunique() == 2 else None
        if model is None:
            return
        check = _best(model.transform(frame(rows[held])), ["doc_id", "pos", "silent", "blind", "own"]).toPandas()
        # rates of their own for quantities whose sentence names a unit and for those whose does not
        parts = {told: check[(check["blind"] >= 0) == told] for told in (True, False)}
        self.steps = {told: isotonic(c["top"].to_numpy(float), (c["own"] == c["predicted"]).to_numpy(float), cautious=True) for told, c in parts.items()}
        self.model = model

    def predict(self, rows: DataFrame, stated: str = "stated") -> DataFrame:
        """``rows`` with ``predicted`` (unit number, null without a model or a candidate) and calibrated ``confidence``."""
        if self.model is None:
            return rows.withColumns({"predicted": F.lit(None).cast("int"), "confidence": F.lit(0.0)})
        asked = rows.select("doc_id", "pos", "value", "source", "concept", stated, "neighbour")
        scored = self.model.transform(self.habits.candidates(asked, stated).withColumn("features", array_to_vector("features")))
        best = _best(scored, ["doc_id", "pos", stated]).select("doc_id", "pos", "predicted", F.when(F.col(stated) >= 0, self._rate(True)).otherwise(self._rate(False)).alias("confidence"))
        return rows.join(best, ["doc_id", "pos"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))

    def _rate(self, told: bool) -> Column:
        at, rate = self.steps[told]
        if not len(at):
            return F.lit(0.0)
        # below the least score seen, in proportion
        step = F.col("top") * float(rate[0] / max(at[0], 1e-9))
        for a, c in zip(at, rate):
            step = F.when(F.col("top") >= float(a), F.lit(float(c))).otherwise(step)
        return step


def _best(scored: DataFrame, by: list[str]) -> DataFrame:
    """(…, predicted, top): the most likely candidate of each quantity, the smaller one of equals."""
    p = vector_to_array(F.col("probability"))[1]
    best = F.max(F.struct(p.alias("p"), (-F.col("candidate")).alias("c"))).alias("x")
    return scored.groupBy(*by).agg(best).select(*by, (-F.col("x.c")).alias("predicted"), F.col("x.p").alias("top"))


def isotonic(score: np.ndarray, right: np.ndarray, steps: int = 20, cautious: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(scores, rates): the rising step function of scores that fits the rates of right predictions best (pool adjacent violators).
    Rates are shrunk towards one half as by one right and one wrong case more; ``cautious`` lowers them by two standard errors. At most ``steps`` steps."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for chunk in np.array_split(order, min(steps, max(1, len(order)))):
        if not len(chunk):
            continue
        blocks.append([float(score[chunk].min()), float(right[chunk].sum()), float(len(chunk))])
        while len(blocks) > 1 and (blocks[-2][1] + 1) * (blocks[-1][2] + 2) >= (blocks[-1][1] + 1) * (blocks[-2][2] + 2):
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    rate = np.array([(b[1] + 1) / (b[2] + 2) for b in blocks])
    if cautious and len(rate):
        rate = np.maximum.accumulate(rate - 2 * np.sqrt(rate * (1 - rate) / np.array([b[2] + 2 for b in blocks])))
    return np.array([b[0] for b in blocks]), rate


def _references(unit_ref: DataFrame, concept_ref: DataFrame) -> tuple[Lexicon, list[str]]:
    lexicon = Lexicon.of([r.asDict() for r in _reference(unit_ref.where("unit is not null and factor is not null"), "units")])
    return lexicon, sorted({r.concept.lower() for r in _reference(concept_ref.where("concept is not null and concept <> ''"), "concepts")})


def harmonise(collection: DataFrame, unit_ref: DataFrame, concept_ref: DataFrame) -> DataFrame:
    """(doc_id, pos, value, unit, base_unit, base_value, how, confidence) of every quantity.

    ``how`` is ``entry`` (the entry names the unit), ``model`` (no entry; confident prediction, not contradicted by the sentence), ``review``
    (uncertain or contradicted; the unit shown is the sentence's, as a proposal), ``open`` (the same, without a unit in the sentence: no base value),
    ``foreign`` (the entry names something that is no unit: no base value); ``stated`` tells whether the sentence gives the unit.

    ``collection``: doc_id, sentence, values, units, source, ingested_at. Records delivered again count once, as last delivered. Null
    or NaN values give no row, and neither do null ids; null sentences and sources are allowed, ``units`` may be null or shorter than
    ``values``; entries beyond the values are ignored. An empty table gives no rows. Other columns are ignored.
    """
    lexicon, concepts = _references(unit_ref, concept_ref)
    read = cut(read_quantities(collection, lexicon, concepts))
    known = read.where("unit >= 0").withColumns({"final": F.col("unit"), "how": F.lit("entry"), "confidence": F.lit(1.0)})
    foreign = read.where(f"unit = {FOREIGN}").withColumns({"final": F.lit(None).cast("int"), "how": F.lit("foreign"), "confidence": F.lit(0.0)})
    guessed = UnitClassifier(read.where("unit >= 0")).predict(read.where(f"unit = {MISSING}"))
    agrees = (F.col("confidence") >= CONFIDENT) & ((F.col("stated") < 0) | (F.col("stated") == F.col("predicted")))
    guessed = guessed.withColumns(
        {
            "final": F.when(agrees, F.col("predicted")).when(F.col("stated") >= 0, F.col("stated")),
            "how": F.when(agrees, "model").when(F.col("stated") >= 0, "review").otherwise("open"),
        }
    )
    columns = ["doc_id", "pos", "value", "stated", "lacks", "final", "how", "confidence"]
    rows = known.select(*columns).unionByName(foreign.select(*columns)).unionByName(guessed.select(*columns))
    pick = lambda xs, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in xs]), F.col("final")) if xs else F.lit(None).cast(kind)
    base = F.col("value") * F.col("lacks") * pick(lexicon.factor, "double") + pick(lexicon.shift, "double")
    return rows.select(
        "doc_id", "pos", "value", pick(lexicon.names, "string").alias("unit"), pick(lexicon.base, "string").alias("base_unit"), base.alias("base_value"),
        "how", "confidence", (F.col("stated") >= 0).alias("stated"),
    )


@pandas_udf(StringType())
def significant(value: pd.Series) -> pd.Series:
    """A number as text with four significant digits, like ``1.250e+04``: rounded from its exact value, ties to the even digit (the JVM's
    formatter rounds the shortest decimal, ties upwards)."""
    return value.map(lambda x: None if x is None else f"{x:.3e}")


def converted(quantities: DataFrame) -> DataFrame:
    """(doc_id, pos, base_unit, base_value as text) of the quantities of ``harmonise`` whose value changes, or whose entry was missing and whose unit the
    model is confident of and the sentence confirms. Quantities under review are not among them."""
    changed = (F.abs(F.col("base_value") - F.col("value")) > 1e-9 * F.greatest(F.abs("base_value"), F.abs("value"))) & (F.col("how") == "entry")
    filled = (F.col("how") == "model") & F.col("stated")
    return quantities.where("base_value is not null").where(changed | filled).select("doc_id", "pos", "base_unit", significant(F.col("base_value")).alias("base_value"))


def held_out_precision(collection: DataFrame, unit_ref: DataFrame, concept_ref: DataFrame, every: int = 4) -> DataFrame:
    """(told, confidence, quantities, right): quantities of known unit of every ``every``th record, predicted with the unit hidden by a classifier that is
    fitted on the others; with what the sentence states (``told``) and without. ``confidence`` is rounded down to a tenth. One row for each that occurs."""
    lexicon, concepts = _references(unit_ref, concept_ref)
    known = cut(read_quantities(collection, lexicon, concepts).where("unit >= 0"))
    asked = F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0
    model, hidden = UnitClassifier(known.where(~asked)), known.where(asked)
    out = None
    for told, rows in ((True, hidden.where("blind >= 0")), (False, hidden.withColumn("blind", F.lit(FOREIGN)))):
        part = model.predict(rows, "blind").select(F.lit(told).alias("told"), (F.floor(F.col("confidence") * 10) / 10).alias("confidence"), F.coalesce(F.col("unit") == F.col("predicted"), F.lit(False)).alias("ok"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("told", "confidence").agg(F.count("*").alias("quantities"), F.count_if("ok").alias("right"))
