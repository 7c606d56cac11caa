"""Generation of training sets from a concept index: pivots, query text, positives and negatives, permutations, splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantmill.functions import numeric as N, text as T
from quantmill.session import cut

GROUP = ("keyword", "unit")
CONDITIONS = ("=", "<", ">")


#: Values of a group beyond which it gets random passes.
EXTRA_VALUES = 8


def draw(seed: int, *columns: str) -> Column:
    """A random text drawn from the columns: the same whatever the partitioning, in any SQL engine. Numbers count as ``numeric.value_text``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def drawn_number(drawn: Column, n: Column) -> Column:
    """A number from 0 to n - 1 by a drawn text."""
    return F.pmod(F.conv(F.substring(drawn, 1, 8), 16, 10).cast("bigint"), n.cast("bigint"))


def concept_index(exported: DataFrame) -> DataFrame:
    """(keyword, unit, value, sentence, value_spans, unit_spans), distinct, from rows of parallel lists; lists are zipped to the shortest.
    Rows with a null keyword or unit are left out; keyword and unit are lower-cased and trimmed."""
    n = F.least(F.size("values"), F.size("sentences"), F.size("values_char"), F.size("unit_char"))
    cols = [F.slice(F.col(c), 1, n).alias(a) for c, a in (("values", "value"), ("sentences", "sentence"), ("values_char", "value_spans"), ("unit_char", "unit_spans"))]
    flat = exported.where("keyword is not null and unit is not null").where(n > 0).select(
        T.unit_key(F.col("keyword")).alias("keyword"), T.unit_key(F.col("unit")).alias("unit"), F.explode(F.arrays_zip(*cols)).alias("x")
    )
    return flat.select("keyword", "unit", "x.value", "x.sentence", "x.value_spans", "x.unit_spans").where("value is not null and sentence is not null").distinct()


def value_counts(index: DataFrame) -> DataFrame:
    """(keyword, unit, value, sentences)."""
    return index.groupBy(*GROUP, "value").agg(F.countDistinct("sentence").alias("sentences"))


def pivots(index: DataFrame, least_values: int = 3) -> DataFrame:
    """(keyword, unit, n_values, equal, equal2, less, less2, greater, greater2) of the groups with at least ``least_values`` values.

    ``equal``: the values of most sentences (ties: smaller value first). With the n values in falling order and m = n div 2: ``less`` is the value at m - 1
    and ``greater`` the one at m + 1, from 0; the second ones lie one further out, and repeat the first where n < 7."""
    counted = value_counts(index)
    by_count = Window.partitionBy(*GROUP).orderBy(F.desc("sentences"), "value")
    by_value = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    ranked = counted.withColumns({"c": F.row_number().over(by_count), "p": F.row_number().over(by_value) - 1})
    n = ranked.groupBy(*GROUP).agg(F.count("*").alias("n_values")).where(F.col("n_values") >= least_values)
    m = F.floor(F.col("n_values") / 2)
    far = F.when(F.col("n_values") < 7, 1).otherwise(2)
    pick = lambda cond: F.max(F.when(cond, F.col("value")))
    return ranked.join(n, list(GROUP)).groupBy(*GROUP, "n_values").agg(
        pick(F.col("c") == 1).alias("equal"), pick(F.col("c") == 2).alias("equal2"),
        pick(F.col("p") == m - 1).alias("less"), pick(F.col("p") == m - far).alias("less2"),
        pick(F.col("p") == m + 1).alias("greater"), pick(F.col("p") == m + far).alias("greater2"),
    )


def random_pivots(index: DataFrame, chosen: DataFrame, seed: int = 7676, each: int = 2) -> DataFrame:
    """(keyword, unit, condition, pivot, turn): ``each`` more pivots for every condition, drawn from the group's values without the two smallest and two
    largest and without the condition's chosen ones; fewer where there are not so many."""
    of = {"=": ("equal", "equal2"), "<": ("less", "less2"), ">": ("greater", "greater2")}
    used = [F.struct(F.lit(c).alias("condition"), F.col(v).alias("value")) for c, names in of.items() for v in names]
    taken = chosen.select(*GROUP, F.explode(F.array(*used)).alias("x")).select(*GROUP, "x.condition", "x.value").where("value is not null").distinct()
    w = Window.partitionBy(*GROUP).orderBy("value")
    inner = index.select(*GROUP, "value").distinct().withColumn("p", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*GROUP)))
    inner = inner.where((F.col("p") > 2) & (F.col("p") <= F.col("n") - 2)).withColumn("condition", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])))
    inner = inner.join(taken, [*GROUP, "condition", "value"], "left_anti")
    order = Window.partitionBy(*GROUP, "condition").orderBy(draw(seed, *GROUP, "condition", N.value_text(F.col("value"))), "value")
    ranked = inner.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= each)
    return ranked.select(*GROUP, "condition", F.col("value").alias("pivot"), "turn")


def condition_pivots(chosen: DataFrame) -> DataFrame:
    """(keyword, unit, condition, pivot) of the first pivots, in long form."""
    pairs = [F.struct(F.lit(c).alias("condition"), F.col(v).alias("pivot")) for c, v in (("=", "equal"), ("<", "less"), (">", "greater"))]
    return chosen.select(*GROUP, F.explode(F.array(*pairs)).alias("x")).select(*GROUP, "x.condition", "x.pivot").where("pivot is not null")


def partition(index: DataFrame, conditions: DataFrame) -> DataFrame:
    """(keyword, unit, condition, pivot, sentence, value, value_spans, unit_spans, side): every sentence of the group as ``pos`` or ``neg``. A value equal to the pivot
    of ``<`` or ``>`` is on neither side; a sentence with several values on a side counts once, with the largest value."""
    joined = index.join(conditions, list(GROUP))
    met = N.satisfies(F.col("condition"), F.col("value"), F.col("pivot"))
    side = F.when(met, "pos").when(F.col("value") != F.col("pivot"), "neg")
    sided = joined.withColumn("side", side).where("side is not null")
    best = F.max_by(F.struct("value", "value_spans", "unit_spans"), "value").alias("x")
    return sided.groupBy(*GROUP, "condition", "pivot", "sentence", "side").agg(best).select(*GROUP, "condition", "pivot", "sentence", "side", "x.*")


def sample(parts: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """At most ``n`` rows of every (group, condition, pivot, side), with ``place`` from 1: by hash, or with no seed in the order of the sentence."""
    order = [draw(seed, "sentence"), "sentence"] if seed is not None else ["sentence"]
    w = Window.partitionBy(*GROUP, "condition", "pivot", "side").orderBy(*order)
    return parts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def sample_counts(parts: DataFrame, n: int) -> DataFrame:
    """(condition, side, groups, cut): how many samples were smaller than asked for."""
    size = parts.groupBy(*GROUP, "condition", "pivot", "side").agg(F.count("*").alias("have"))
    return size.groupBy("condition", "side").agg(F.count("*").alias("groups"), F.count_if(F.col("have") < n).alias("cut"))


def triples(sampled: DataFrame) -> DataFrame:
    """(keyword, unit, condition, pivot, place, positive, negative): positives and negatives zipped by place, to the shorter."""
    key = [*GROUP, "condition", "pivot", "place"]
    pos = sampled.where("side = 'pos'").select(*key, F.col("sentence").alias("positive"))
    return pos.join(sampled.where("side = 'neg'").select(*key, F.col("sentence").alias("negative")), key)


def with_corpus_sentences(sampled: DataFrame, corpus: DataFrame, seed: int = 7676) -> DataFrame:
    """``sampled`` with every positive twice, and for every positive one sentence drawn from ``corpus`` (sentence) as a negative.

    The distinct sentences are numbered in a random order without bringing them into one task, and every positive draws a number: each sentence can be drawn."""
    pool = corpus.where("sentence is not null and sentence <> ''").select(F.col("sentence").alias("drawn")).distinct()
    numbered = with_ids(pool.withColumn("_r", draw(seed, "drawn")), "number", ["_r", "drawn"]).select("number", "drawn")
    size = F.lit(numbered.count())
    pos = sampled.where("side = 'pos'")
    number = drawn_number(draw(seed + 1, *GROUP, "condition", N.value_text(F.col("pivot")), "sentence"), size)
    added = pos.withColumn("number", number).join(numbered, "number").withColumn("sentence", F.col("drawn")).withColumn("side", F.lit("neg")).select(*sampled.columns)
    twice = pos.withColumn("_", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_")
    return twice.unionByName(sampled.where("side = 'neg'")).unionByName(added)


def all_conditions(index: DataFrame, extensions: DataFrame | None = None, extra_values: int = EXTRA_VALUES, seed: int = 7676) -> DataFrame:
    """(keyword, unit, condition, pivot, asked, pass): the base pass; the same queries with the extension of the concept as keyword (``extensions``: keyword,
    extension); and two random passes for groups of more than ``extra_values`` values. Query text uses ``asked``, sentences the keyword."""
    chosen = pivots(index)
    base = condition_pivots(chosen).withColumns({"asked": F.col("keyword"), "pass": F.lit("base")})
    many = value_counts(index).groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") > extra_values)
    extra = random_pivots(index, chosen, seed).join(many.select(*GROUP), list(GROUP)).withColumns({"asked": F.col("keyword"), "pass": F.concat(F.lit("random"), F.col("turn").cast("string"))})
    out = base.unionByName(extra.drop("turn"))
    if extensions is None:
        return out
    named = out.join(extensions.select("keyword", "extension"), "keyword").withColumns({"asked": F.col("extension"), "pass": F.concat("pass", F.lit("+extension"))})
    return out.unionByName(named.drop("extension"))


def value_permutation(parts: DataFrame, seed: int = 7676) -> DataFrame:
    """Each sentence with its value swapped for one from the other side of the condition: its side changes. (…, sentence, permuted, value, new_value, side)

    The distinct values of each side are numbered, and a sentence joins the one that it draws."""
    key = [*GROUP, "condition", "pivot"]
    turned = F.when(F.col("side") == "pos", "neg").otherwise("pos")
    values = parts.select(*key, turned.alias("side"), F.col("value").alias("new_value")).distinct()
    numbered = values.withColumn("number", F.row_number().over(Window.partitionBy(*key, "side").orderBy("new_value")) - 1)
    size = numbered.groupBy(*key, "side").agg(F.count("*").alias("size"))
    usable = parts.where(F.size("value_spans") > 0).where(F.col("value_spans")[0]["end"] > F.col("value_spans")[0]["start"])
    number = drawn_number(draw(seed, "sentence"), F.col("size")).cast("int")
    new = usable.join(size, [*key, "side"]).withColumn("number", number).join(numbered, [*key, "side", "number"])
    text = T.splice(F.col("sentence"), F.col("value_spans")[0], N.plain_number(F.col("new_value")))
    return new.select(*key, "sentence", text.alias("permuted"), "value", "new_value", turned.alias("side"))


def unit_forms(unit_ref: DataFrame) -> DataFrame:
    """(unit_type, unit, form) of the real units."""
    return unit_ref.where("unit_type <> 'scale'").select("unit_type", "unit", F.explode("forms").alias("form"))


def sibling_forms(forms: DataFrame) -> DataFrame:
    """(unit, form): the forms of the other units of the same type, without the unit's own forms."""
    other = forms.select("unit_type", F.col("unit").alias("other"), "form")
    pairs = forms.select("unit_type", "unit").distinct().join(other, "unit_type").where("unit <> other").select("unit", "form").distinct()
    return pairs.join(forms.select("unit", "form"), ["unit", "form"], "left_anti")


#: What stands between the two sides of a compound unit.
PER = " per "


def compound_forms(units: DataFrame, forms: DataFrame) -> DataFrame:
    """(unit, form, side): for compound units (``a per b`` of two known forms) the forms in which one side is rewritten: by another form of the same
    unit (``pos``) or by a form of another unit of its type (``neg``); the other side stays. ``units`` (unit)."""
    sides = F.split(F.col("unit"), PER)
    two = units.select("unit").distinct().where(F.size(sides) == 2).select("unit", sides[0].alias("a"), sides[1].alias("b"))
    own = forms.join(forms.select("unit", F.col("form").alias("other")), "unit").select("form", F.col("other").alias("to"), F.lit("pos").alias("side"))
    far = forms.select("unit", "form").join(sibling_forms(forms).select("unit", F.col("form").alias("to")), "unit").select("form", "to", F.lit("neg").alias("side"))
    change = own.unionByName(far).where("form <> to").distinct()
    known = forms.select("form").distinct()
    both = two.join(known.select(F.col("form").alias("a")), "a").join(known.select(F.col("form").alias("b")), "b")
    left = both.join(change, F.col("a") == F.col("form")).select("unit", F.concat("to", F.lit(PER), "b").alias("new"), "side")
    right = both.join(change, F.col("b") == F.col("form")).select("unit", F.concat("a", F.lit(PER), "to").alias("new"), "side")
    return left.unionByName(right).select("unit", F.col("new").alias("form"), "side").distinct()


def unit_permutation(index: DataFrame, forms: DataFrame, seed: int = 7676) -> DataFrame:
    """(keyword, unit, sentence, permuted, form, side): the first unit span rewritten by another form of the same unit (``pos``) and by a form of another unit of the
    same type (``neg``). A span of one character takes a form of one character if there is one. Of compound units one side is rewritten."""
    usable = index.where(F.size("unit_spans") > 0).where(F.col("unit_spans")[0]["end"] > F.col("unit_spans")[0]["start"])
    compound = cut(compound_forms(index, forms))
    named = forms.select(F.col("form").alias("unit"), F.col("unit").alias("name")).join(compound.select("unit"), "unit", "left_anti")
    named = named.unionByName(compound.select("unit", F.col("unit").alias("name")).distinct())
    rows = usable.join(named, "unit")
    own = forms.select(F.col("unit").alias("name"), "form").withColumn("side", F.lit("pos"))
    far = sibling_forms(forms).select(F.col("unit").alias("name"), "form").withColumn("side", F.lit("neg"))
    every = own.unionByName(far).unionByName(compound.select(F.col("unit").alias("name"), "form", "side"))
    pool = every.groupBy("name", "side").agg(F.array_sort(F.collect_set("form")).alias("pool"))  # at most as many as the lexicon has forms
    joined = rows.join(pool, "name")
    one = F.filter("pool", lambda f: F.length(f) == 1)
    short = (F.col("unit_spans")[0]["end"] - F.col("unit_spans")[0]["start"] == 1) & (F.size(one) > 0)
    choice = F.filter(F.when(short, one).otherwise(F.col("pool")), lambda f: f != F.col("unit"))
    picked = joined.withColumn("choice", choice).where(F.size("choice") > 0).withColumn("form", F.get("choice", drawn_number(draw(seed, "sentence"), F.size("choice")).cast("int")))
    return picked.select(*GROUP, "sentence", T.splice(F.col("sentence"), F.col("unit_spans")[0], F.col("form")).alias("permuted"), "form", "side")


def generated_queries(conditions: DataFrame) -> DataFrame:
    """(query_id, keyword, unit, condition, pivot, query): ids count from 0 in the order of keyword, unit and condition."""
    pick = drawn_number(draw(0, "keyword", "unit", N.value_text(F.col("pivot"))), F.lit(1 << 20))
    asked = F.col("asked") if "asked" in conditions.columns else F.col("keyword")
    text = F.coalesce(*[F.when(F.col("condition") == c, N.template_query(asked, c, F.col("pivot"), F.col("unit"), pick)) for c in CONDITIONS])
    return with_ids(conditions.withColumn("query", text), "query_id", [c for c in ("keyword", "unit", "condition", "pivot", "pass") if c in conditions.columns])


def with_ids(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Consecutive numbers from 0 in a total order, without bringing the rows into one task: rows are sorted by range, counted per
    partition, and numbered from the partition's offset."""
    # materialised, so that a row keeps its partition's number in both uses
    sorted_rows = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = sorted_rows.groupBy("_p").agg(F.count("*").alias("c"))
    offsets = counts.withColumn("_start", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return sorted_rows.withColumn("_i", within).join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_start") + F.col("_i")).cast("bigint")).drop("_p", "_i", "_start")


def split_validation(rows: DataFrame, key: str, n: int = 100, seed: int = 77) -> tuple[DataFrame, DataFrame]:
    """(training, validation): ``n`` keys of least hash form the validation part."""
    held = rows.select(key).distinct().orderBy(draw(seed, key), key).limit(n)
    return rows.join(held, key, "left_anti"), rows.join(held, key, "left_semi")


def split_tables(tables: dict[str, DataFrame], held: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(training, validation) of generated tables by the queries of ``held`` (query_id): each table goes with its queries, passages with those that judge
    them. ``held`` is drawn (``split_validation``) or supplied; ids that are not known change nothing."""
    names = held.select("query_id").distinct()
    texts = tables["queries"].join(names, "query_id", "left_semi").select("query").distinct()
    judged = tables["qrel"].join(names, "query_id", "left_semi").select("passage_id").distinct()
    key = {"queries": ("query_id", names), "qrel": ("query_id", names), "id_triples": ("query_id", names), "triples": ("query", texts), "collection": ("passage_id", judged)}
    part = lambda how: {n: t.join(key[n][1], key[n][0], how) for n, t in tables.items()}
    return part("left_anti"), part("left_semi")


def lookup_concepts(keywords: DataFrame, extensions: DataFrame) -> DataFrame:
    """(keyword, concept, extension): the dictionary entry of a keyword: itself, else without its last letter, else one of as many words, all of them
    the keyword's, in any order and with repetitions (keywords of up to four words)."""
    words = F.split("keyword", " ")
    distinct = lambda c: F.array_sort(F.array_distinct(F.split(c, " ")))
    signature = lambda count, ws: F.concat(F.lit("\u0001"), F.size(count).cast("string"), F.lit(" "), F.array_join(ws, " "))
    # a concept of some of the words, repeated, has the signature of a subset of them
    subset = lambda m: F.filter(distinct(F.col("keyword")), lambda _, i: F.lit(m).bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0)
    subsets = [F.struct(F.lit(3).alias("p"), F.when(F.size(words) <= 4, signature(words, subset(m))).alias("probe")) for m in range(1, 16)]
    probes = keywords.select("keyword", F.explode(F.array(
        F.struct(F.lit(1).alias("p"), F.col("keyword").alias("probe")),
        F.struct(F.lit(2).alias("p"), F.expr("substring(keyword, 1, length(keyword) - 1)").alias("probe")), *subsets,
    )).alias("x")).select("keyword", "x.p", "x.probe").where("probe is not null").distinct()
    own = signature(F.split("concept", " "), distinct(F.col("concept")))
    entries = extensions.select("concept", "extension", F.explode(F.array(F.col("concept"), own)).alias("probe"))
    hit = probes.join(entries, "probe").groupBy("keyword").agg(F.min(F.struct("p", "concept", "extension")).alias("h"))
    return hit.select("keyword", "h.concept", "h.extension")


Strategy = Callable[[DataFrame], DataFrame]


def training_tables(index: DataFrame, n: int = 3, seed: int | None = 7676, strategies: list[Strategy] | None = None, conditions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The generated tables: queries (query_id, query), collection (passage_id, sentence), qrel (query_id, passage_id, rel), triples (query, positive,
    negative) and id_triples (query_id, positive, negative) by passage. ``strategies`` add passages: functions from the sided sentences to rows
    of the same columns. ``conditions``: those of the base pass, or of all passes (``all_conditions``)."""
    conditions = cut(conditions if conditions is not None else condition_pivots(pivots(index)))
    key = [*GROUP, "condition", "pivot"]
    parts = partition(index, conditions.select(*key).distinct())
    for s in strategies or []:
        parts = parts.unionByName(s(parts), allowMissingColumns=True)
    chosen = sample(parts, n, seed)
    queries = generated_queries(conditions)
    passages = with_ids(chosen.join(queries.select(*key, "query_id", "query"), key), "passage_id", ["query_id", "side", "place"])
    side = lambda s, name: passages.where(F.col("side") == s).select("query_id", "query", "place", F.col("sentence").alias(name), F.col("passage_id").alias(f"{name}_id"))
    three = side("pos", "positive").join(side("neg", "negative").drop("query"), ["query_id", "place"])
    return {
        "queries": queries.select("query_id", "query"),
        "collection": passages.select("passage_id", "sentence"),
        "qrel": passages.select("query_id", "passage_id", F.when(F.col("side") == "pos", 1).otherwise(0).alias("rel")),
        "triples": three.select("query", "positive", "negative"),
        "id_triples": three.select("query_id", F.col("positive_id").alias("positive"), F.col("negative_id").alias("negative")),
    }


def masked(index: DataFrame) -> DataFrame:
    """(keyword, unit, value, sentence, masked_value, masked_unit, masked_both)."""
    s = F.col("sentence")
    return index.select(
        *GROUP, "value", "sentence", T.mask(s, F.col("value_spans")).alias("masked_value"), T.mask(s, F.col("unit_spans")).alias("masked_unit"),
        T.mask(s, F.array_union("value_spans", "unit_spans")).alias("masked_both"),
    )
