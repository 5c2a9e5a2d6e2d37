"""Final answers from candidate pools: which pools speak for a task is a table of Parts, the operators are the same."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import medoid as M
from corvane.operators import repair as R
from corvane.operators.ranks import checkpointed
from corvane.operators.vote import interleaved, majority, pool_arrays


@dataclass(frozen=True)
class Part:
    """Values of a source's kind, of the item itself, of its sibling, or of items without sibling (orphan)."""

    source: str
    kind: str
    of: str = "own"
    cap: int | None = None
    stance: bool = False  # samples are read as yes or no
    tag: str | None = None  # only values that were made for this task


#: The full ensemble: fast, base, boxed, second model; o_ pools speak for items without sibling.
FULL = {
    "bcq": (Part("base", "votes"), Part("boxed", "votes"), Part("fast", "samples", "sibling", stance=True), Part("second", "samples", "sibling", stance=True), Part("o_fast", "votes", "orphan"), Part("o_second", "votes", "orphan")),
    "mcq": (Part("base", "picks"), Part("boxed", "picks"), Part("fast", "picks", "sibling"), Part("second", "picks", "sibling"), Part("o_fast", "picks", "orphan"), Part("o_second", "picks", "orphan")),
    "mcq_openended": (Part("base", "picks"), Part("fast", "picks"), Part("second", "picks"), Part("boxed", "picks", "sibling"), Part("o_boxed", "picks", "orphan", 4)),
    "bcq_openended": (Part("fast", "samples", stance=True), Part("second", "samples", stance=True), Part("base", "votes", "sibling"), Part("boxed", "votes", "sibling"), Part("o_base", "votes", "orphan"), Part("o_boxed", "votes", "orphan")),
}


def _more(of: str = "own") -> tuple[Part, ...]:
    """Picks over further orders of the options, of both models."""
    return Part("extra_base", "picks", of), Part("extra", "picks", of)


#: Two models only.
COMPLIANT = {
    "bcq": (Part("base", "votes"), Part("second", "votes"), Part("second", "samples", "sibling", stance=True), Part("o_second", "votes", "orphan")),
    "mcq": (Part("base", "picks"), Part("second", "picks"), *_more(), Part("second", "picks", "sibling"), *_more("sibling"), Part("o_second", "picks", "orphan")),
    "mcq_openended": (Part("base", "picks"), Part("second", "picks"), *_more(), Part("second", "picks", "sibling"), *_more("sibling")),
    "bcq_openended": (Part("second", "samples", stance=True), Part("base", "votes", "sibling"), Part("o_base", "votes", "orphan")),
}
#: What an open item takes once its closed sibling says no.
REGENERATED = {"bcq_openended": (Part("evidence", "samples", tag="bcq_oe_no"),)}
DESCRIPTIVE = ("open_qa", "scene_description", "video_summarization", "causal_linkage", "temporal_description")


#: Free texts of all descriptive tasks, and the grounded ones, which come before what all tasks have.
DESCRIBED = {task: (Part("fast_desc", "samples"), Part("second_desc", "samples")) for task in DESCRIPTIVE}
GROUNDED = {
    "open_qa": (Part("evidence", "samples", tag="open_qa"),),
    "causal_linkage": (Part("evidence", "samples", tag="causal_linkage"),),
    "video_summarization": (Part("summary_option", "samples"), Part("summary_event", "samples")),
    "temporal_description": (Part("event", "samples"),),
}


def without(recipe: dict[str, tuple[Part, ...]], *sources: str) -> dict[str, tuple[Part, ...]]:
    """The recipe with some sources switched off."""
    return {task: tuple(p for p in parts if p.source not in sources) for task, parts in recipe.items()}


def recipe_table(spark: SparkSession, recipe: dict[str, tuple[Part, ...]]) -> DataFrame:
    """(task, at, source, kind, of, cap, stance, tag): a row a part, at is its place among the task's parts."""
    rows = [(task, k, p.source, p.kind, p.of, p.cap, p.stance, p.tag) for task, parts in recipe.items() for k, p in enumerate(parts)]
    return spark.createDataFrame(rows, "task string, at int, source string, kind string, of string, cap int, stance boolean, tag string")


def gather(items: DataFrame, pools: DataFrame, siblings: DataFrame | None, recipe: dict[str, tuple[Part, ...]]) -> DataFrame:
    """(item, task, pos, value, raw, of, stance) of all parts of all tasks, in the order of the recipe; raw is the value
    before a stance was read.

    The recipe is a table, broadcast as it is a setting and has a row a part. It says what each item asks for, and one
    equi-join on (key, source, kind) fetches it: one pass over the pools, whatever the number of tasks and parts. Only
    sources and kinds that the recipe names leave the scan."""
    parts = recipe_table(items.sparkSession, recipe)
    keyed = items.select("item", "task")
    keyed = keyed.join(siblings, "item", "left") if siblings is not None else keyed.withColumn("sibling", F.lit(None).cast(items.schema["item"].dataType))
    key = F.when(F.col("of") == "own", F.col("item")).when(F.col("of") == "sibling", F.col("sibling")).when(F.col("sibling").isNull(), F.col("item"))
    asked = keyed.join(F.broadcast(parts), "task").select("item", "task", "at", "of", "cap", "stance", "tag", "source", "kind", key.alias("k")).filter("k is not null")
    named = sorted({(p.source, p.kind) for parts_ in recipe.values() for p in parts_})
    wanted = F.lit(False)
    for source, kind in named:
        wanted = wanted | ((F.col("source") == source) & (F.col("kind") == kind))
    tag = F.col("task") if "task" in pools.columns else F.lit(None).cast("string")
    rows = pools.filter(wanted).select("source", "kind", F.col("item").alias("k"), F.col("pos").cast("long").alias("pos"), F.col("value").alias("raw"), tag.alias("said_for"))
    got = asked.join(rows, ["k", "source", "kind"]).filter("tag is null or tag = said_for")
    if any(p.cap for parts_ in recipe.values() for p in parts_):
        place = F.row_number().over(W.partitionBy("item", "at").orderBy("pos"))
        got = got.withColumn("place", F.when(F.col("cap").isNotNull(), place)).filter("cap is null or place <= cap")
    value = F.when(F.col("stance"), T.yes_no(T.unwrap_or_unthink(F.col("raw")))).otherwise(F.col("raw"))
    return got.select("item", "task", (F.col("at").cast("long") * (1 << 31) + F.col("pos")).alias("pos"), value.alias("value"), "raw", "of", "stance")


def choices(items: DataFrame, pools: DataFrame, siblings: DataFrame, base: DataFrame, recipe=FULL, similarity=M.token_f1, default_no: bool = True) -> tuple[DataFrame, DataFrame]:
    """((item, prediction), (item, pool) of the polar votes)."""
    pred, polar = voted(items, pools, siblings, base, recipe, similarity, default_no)
    return pred, pool_arrays(polar)


def voted(items: DataFrame, pools: DataFrame, siblings: DataFrame, base: DataFrame, recipe=FULL, similarity=M.token_f1, default_no: bool = True, texts: DataFrame | None = None, distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """((item, prediction), (item, pos, value) of the polar votes). items (item, video, task, question, ord); base (item,
    prediction) answers where pools are silent; texts (item, pos, value) are the candidates of the descriptive tasks
    (DESCRIBED's if none are given); distinct: medoids without repeats.

    All tasks vote in one aggregate, and all free texts have one medoid. What was gathered and what won are used several
    times, so they are written once; later steps read that."""
    got = checkpointed(gather(items, pools, siblings, recipe))
    opts = items.filter(F.col("task").isin("mcq", "mcq_openended")).select("item", "task", T.options(F.col("question")).alias("o")).filter("o is not null")
    listed = got.filter(F.col("task").isin("mcq", "mcq_openended")).join(opts.select("item", T.normal_options(F.col("o")).alias("opts")), "item").filter(F.array_contains("opts", F.col("value")))
    polar = got.filter("task = 'bcq' and value <> ''")
    votes = polar.unionByName(got.filter("task = 'bcq_openended'")).select("item", "pos", "value").unionByName(listed.select("item", "pos", "value"))
    won = checkpointed(majority(votes).select("item", F.col("value").alias("won")))
    asked = items.select("item", "task").join(won, "item", "left").join(opts.drop("task"), "item", "left")
    letter = T.letter_of(F.col("o"), F.col("won"))
    body = F.element_at(T.option_array(F.col("o")), F.array_position(F.array(*map(F.lit, T.LETTERS)), letter).cast("int"))
    said = F.when(F.col("won") == "yes", "Yes").when(F.col("won").isNotNull(), "No").otherwise(F.lit("No" if default_no else None))
    chosen = asked.select("item", "task", "won", F.when(F.col("task") == "bcq", said).when(F.col("task") == "mcq", letter).when(F.col("task") == "mcq_openended", F.concat(letter, F.lit(". "), body)).alias("p"))

    if texts is None:
        texts = gather(items, pools, None, DESCRIBED).select("item", "pos", T.unwrap_or_unthink(F.col("raw")).alias("value"))
    open_ = stance_texts(got, won)
    found = M.medoid(open_.unionByName(texts.select("item", "pos", "value")), similarity, distinct=distinct).select("item", F.col("value").alias("q"))
    pred = chosen.join(found, "item", "left").join(base, "item", "left").select("item", F.coalesce("p", "q", "prediction", F.lit("")).alias("prediction"))
    return pred, polar.select("item", "pos", "value")


def stance_texts(got: DataFrame, won: DataFrame) -> DataFrame:
    """(item, pos, value): of the open polar items the own texts that take the stance that won; all, if none does."""
    own = got.filter("task = 'bcq_openended' and of = 'own' and stance").select("item", "pos", F.col("value").alias("stance"), T.unwrap_or_unthink(F.col("raw")).alias("value")).filter("value <> ''")
    seen = own.join(won, "item", "left").withColumn("ok", F.coalesce(F.col("stance") == F.coalesce("won", F.lit("no")), F.lit(False)))
    some = seen.groupBy("item").agg(F.max("ok").alias("some"))
    return seen.join(some, "item").filter("ok or not some").select("item", "pos", "value")


def open_texts(items: DataFrame, pools: DataFrame, rich: DataFrame, compliant: bool = False, recipe=None) -> DataFrame:
    """(item, pos, value): the candidates of the descriptive tasks, distinct, the first 48 (all of a scene's; what caps a
    scene is the medoid that the caller asks for). rich (item, pos, value) is what all tasks have; grounded pools come first. The temporal task uses its grounded pool alone if it has two texts; the
    compliant form falls back to rich."""
    first = gather(items, pools, None, GROUNDED if recipe is None else recipe)
    unwrap = T.unwrap_or_unthink if compliant else T.unwrap_then_unthink
    first = first.select("item", "task", "pos", unwrap(F.col("raw")).alias("value")).filter("value <> ''")
    alone = "temporal_description"
    enough = first.filter(F.col("task") == alone).groupBy("item").agg(F.count("*").alias("n")).filter("n >= 2").select("item", F.lit(True).alias("enough"))
    first = first.join(enough, "item", "left").filter((F.col("task") != alone) | F.col("enough"))
    asked = items.filter(F.col("task").isin(*DESCRIPTIVE)).select("item", "task").join(enough, "item", "left")
    asked = asked.filter((F.col("task") != alone) | (F.col("enough").isNull() & F.lit(compliant)))
    rest = asked.join(rich.select("item", (F.lit(1 << 52) + F.col("pos")).alias("pos"), "value"), "item").filter("value <> ''")
    pool = first.select("item", "task", "pos", "value").unionByName(rest.select("item", "task", "pos", "value"))
    pool = pool.groupBy("item", "task", "value").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(W.partitionBy("item").orderBy("pos"))
    return pool.withColumn("place", place).filter((F.col("place") <= 48) | (F.col("task") == "scene_description")).select("item", "pos", "value")


def open_recipes(items: DataFrame, pools: DataFrame, rich: DataFrame, similarity=M.token_f1, compliant: bool = False) -> DataFrame:
    """(item, value) of the descriptive tasks: one medoid over open_texts."""
    return M.medoid(open_texts(items, pools, rich, compliant), similarity, distinct=False)


def rich_texts(pools: DataFrame, first: str = "second_desc", second: str = "second_draw") -> DataFrame:
    """(item, pos, value): two draws of one model in turn, then the longer one's rest; empty texts take no place."""
    draw = lambda source: pools.filter((F.col("source") == source) & (F.col("kind") == "samples")).select("item", "pos", T.unwrap_or_unthink(F.col("value")).alias("value")).filter("value <> ''")
    return interleaved(draw(first), draw(second)).select("item", "pos", "value")


def compliant_answers(items: DataFrame, pools: DataFrame, siblings: DataFrame, similarity=M.token_f1, single_model: bool = False, pair_repair: bool = False, events: bool = True) -> DataFrame:
    """(item, prediction): the assembly from two models, or one (single_model), end to end. items (item, video, task,
    question, ord). Switches take rows off the recipe: single_model the base model's, events=False the event pool.

    Votes and texts are chosen first; then, if asked for, the members of a pair that answered alike are parted; last, an
    open item whose closed sibling says no takes the medoid of its evidence texts, if that says no. An item without any
    candidate gets ''."""
    recipe = without(COMPLIANT, "base", "o_base", "extra_base") if single_model else COMPLIANT
    grounded = GROUNDED if events else without(GROUNDED, "event")
    blank = items.select("item", F.lit("").alias("prediction"))
    texts = open_texts(items, pools, rich_texts(pools), True, grounded)
    pred, polar = voted(items, pools, siblings, blank, recipe, similarity, False, texts, True)
    pred = checkpointed(pred)  # closed items are looked up in it for their siblings: without this all medoids are made twice
    if pair_repair:
        margins = majority(polar).select("item", F.col("margin_b").alias("margin_a"))
        members = items.filter("task = 'bcq'").select(F.col("video").alias("group"), "item", "ord").join(pred, "item").join(margins, "item", "left").fillna({"margin_a": 0.0})
        mended = R.pair_repair(members.withColumn("verdict", F.lit(None).cast("string"))).select("item", F.col("prediction").alias("mended"))
        pred = pred.join(mended, "item", "left").select("item", F.coalesce("mended", "prediction").alias("prediction"))
    evidence = gather(items, pools, None, REGENERATED).select("item", "pos", T.unwrap_or_unthink(F.col("raw")).alias("value"))
    closed = items.filter("task = 'bcq_openended'").select("item").join(siblings, "item")
    stances = closed.join(pred.select(F.col("item").alias("sibling"), F.lower(T.strip(T.text("prediction"))).alias("stance")), "sibling").select("item", "stance")
    return R.no_stance_texts(pred, stances, M.medoid(evidence, similarity))


def finished(pred: DataFrame, groups: DataFrame, verdicts: DataFrame, margins: DataFrame, closed: DataFrame, texts: DataFrame, fallback: DataFrame) -> DataFrame:
    """The decisions after the vote in their order: judge override, pair repair, no-stance texts, guard against blanks.

    pred (item, prediction); groups (group, item, ord), pairs whose answers must differ; verdicts (item, verdict);
    margins (item, margin_a); closed (item, sibling), the closed item whose repaired answer is an open item's stance; texts
    and fallback (item, value). Every step is an equi-join on item, or an aggregate by group."""
    told = R.override(pred, verdicts, margins)
    members = groups.join(told, "item").join(margins.select("item", "margin_a"), "item", "left").join(verdicts.select("item", "verdict"), "item", "left")
    mended = R.pair_repair(members).select("item", F.col("prediction").alias("mended"))
    said = told.join(mended, "item", "left").select("item", F.coalesce("mended", "prediction").alias("prediction"))
    stances = closed.join(said.select(F.col("item").alias("sibling"), F.lower(T.strip(T.text("prediction"))).alias("stance")), "sibling").select("item", "stance")
    return R.guard(R.no_stance_texts(said, stances, texts), fallback)
