"""Candidate generation as one plan: a generator is a table of steps, and all generators run the same way.

An item becomes one row with all its requests, is asked in its partition, and its answers are read into votes, picks and
samples by column functions. Items are shuffled only against what is done already, and nothing is grouped: an item never
leaves its row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.frames import let
from corvane.operators.pools import resume
from corvane.sources.calls import answered
from corvane.sources.generate import Client

# The orders in which four options are shown (each number is the option behind that letter), and the
# sentences that follow them.
ROTATIONS = ((0, 1, 2, 3), (1, 2, 3, 0), (2, 3, 0, 1), (3, 0, 1, 2))
MORE_ORDERS = ((3, 2, 1, 0), (2, 1, 0, 3), (1, 0, 3, 2), (0, 3, 2, 1), (0, 1, 3, 2), (1, 0, 2, 3), (2, 0, 3, 1), (3, 1, 2, 0))
CHOOSE = "Choose the correct option. Answer with the letter."
CHOOSE_ELSE = "Answer with the letter of the correct option."
DESCRIPTIVE = ("open_qa", "causal_linkage", "temporal_description", "video_summarization", "scene_description")


@dataclass(frozen=True)
class Step:
    """Requests for items of some tasks (None: all). kind: votes (yes or no of each answer), picks (the option behind the
    letter, one request an order of the options), samples or greedy (the text)."""

    tasks: tuple[str, ...] | None
    kind: str
    n: int = 1
    temperature: float = 0.0
    top_p: float = 0.95
    orders: tuple[tuple[int, ...], ...] = ROTATIONS


@dataclass(frozen=True)
class Generator:
    """on_error: `item` gives a finished row with err and nothing else; `blank` a finished row with nothing and no err;
    `request` leaves out what failed; `raise` ends the run. own_order: options are marked `A)` and followed by the
    question's own sentence. sibling: the question asked is the column sibling_question, and picks mean the original's
    option that is likest. forms: only items whose form is among them."""

    steps: tuple[Step, ...]
    on_error: str = "item"
    boxed: bool = False
    sibling: bool = False
    forms: tuple[str, ...] | None = None
    own_order: bool = False
    thoughts: bool = False
    raw: bool = False
    max_tokens: int = 512

    def tasks(self) -> tuple[str, ...] | None:
        named = [s.tasks for s in self.steps]
        return None if None in named else tuple(sorted({t for ts in named for t in ts}))


_VOTES, _CHOICES = dict(kind="votes", n=5, temperature=0.8), ("mcq", "mcq_openended")
GENERATORS: dict[str, Generator] = {
    "second": Generator((Step(("bcq",), **_VOTES), Step(("bcq_openended",), "samples", 5, 0.8), Step(_CHOICES, "picks"))),
    "boxed": Generator((Step(("bcq",), **_VOTES), Step(("mcq",), "picks")), boxed=True, max_tokens=400),
    "orphans": Generator((Step(("bcq", "bcq_openended"), **_VOTES), Step(_CHOICES, "picks")), sibling=True, max_tokens=400),
    "orphans_boxed": Generator((Step(("bcq", "bcq_openended"), **_VOTES), Step(_CHOICES, "picks")), sibling=True, boxed=True, forms=("plain",), max_tokens=400),
    "more_orders": Generator((Step(_CHOICES, "picks", top_p=1.0, orders=MORE_ORDERS),), on_error="request", thoughts=True),
    "open_choices": Generator((Step(("mcq_openended",), "picks"), Step(("bcq_openended",), "samples", 5, 0.8)), on_error="request", own_order=True, raw=True, max_tokens=400),
    "greedy": Generator((Step(None, "greedy"),), on_error="blank"),
    "descriptive": Generator((Step(DESCRIPTIVE, "greedy", top_p=1.0), Step(DESCRIPTIVE, "samples", 12, 0.7)), on_error="blank", raw=True),
}
REQUEST = "array<struct<kind:string,prompt:string,video:string,n:int,temperature:double,top_p:double,seed:int,max_tokens:int,meant:array<string>>>"


def _asked_options(g: Generator, question: Column, options: Column, order: tuple[int, ...]) -> Column:
    head = F.element_at(F.split(T.text(question), r"(?md)^\s*A[.)]\s", 2), 1)
    four = T.option_array(options)
    mark = ") " if g.own_order else ". "
    body = F.concat_ws("\n", *(F.concat(F.lit(l + mark), four[k]) for l, k in zip(T.LETTERS, order)))
    if not g.own_order:
        return F.concat(head, body, F.lit("\n" + CHOOSE))
    own = F.trim(F.regexp_extract(T.text(question), r"(?:Choose the correct|Answer with)[^\n]*", 0))
    return F.concat(T.strip(head), F.lit("\n"), body, F.lit("\n"), F.when(own != "", own).otherwise(CHOOSE_ELSE))


def with_requests(items: DataFrame, g: Generator, legend: str = "", seed: int = 0) -> DataFrame:
    """items (item, task, question, video; sibling_question if g.sibling) with `requests`. Picks are asked only where the
    question lists its four options (and, for siblings, the original too); `meant` says what each letter stands for."""
    asked = F.col("sibling_question") if g.sibling else F.col("question")
    rows = items.withColumn("asked_", T.options(asked))
    rows = rows.withColumn("kept_", T.options(F.col("question")) if g.sibling else F.col("asked_"))

    def one(s: Step, prompt: Column, meant: Column) -> Column:
        text = F.concat(F.lit(legend), F.coalesce(prompt, F.lit(""))) if g.boxed else F.coalesce(prompt, F.lit(""))
        return F.struct(F.lit(s.kind).alias("kind"), text.alias("prompt"), F.col("video").alias("video"), F.lit(s.n).alias("n"), F.lit(float(s.temperature)).alias("temperature"), F.lit(float(s.top_p)).alias("top_p"), F.lit(seed).alias("seed"), F.lit(g.max_tokens).alias("max_tokens"), meant.alias("meant"))

    def meant(k: int) -> Column:
        shown = T.option_array(F.col("asked_"))[k]
        if not g.sibling:
            return T.normal_option(shown)
        best = T.best_option(shown, F.col("kept_"))
        out = F.lit(None).cast("string")
        for l in T.LETTERS:
            out = F.when(best == l, T.normal_option(F.col("kept_")[l])).otherwise(out)
        return out

    parts = []
    for s in g.steps:
        if s.kind == "picks":
            here = F.col("asked_").isNotNull() & F.col("kept_").isNotNull()
            some = F.array(*(one(s, _asked_options(g, asked, F.col("asked_"), o), F.array(*(meant(k) for k in o))) for o in s.orders))
        else:
            here, some = F.lit(True), F.array(one(s, asked, F.lit(None).cast("array<string>")))
        if s.tasks is not None:
            here = here & F.col("task").isin(*s.tasks)
        parts.append(F.when(here, some.cast(REQUEST)).otherwise(F.array().cast(REQUEST)))
    return rows.withColumn("requests", F.concat(*parts)).drop("asked_", "kept_")


def with_values(rows: DataFrame, g: Generator) -> DataFrame:
    """requests and answers to item, task, form, votes, picks, samples, greedy, err, done. Order within a list is that of
    the requests and answers; an answer without a yes, a no or a letter of an option leaves no value."""
    form = F.col("form") if "form" in rows.columns else F.lit(None)
    first = F.filter("answers", lambda a: a["err"].isNotNull())
    err = F.try_element_at(first, F.lit(1))["err"]
    whole = F.lit(True) if g.on_error in ("request", "raise") else err.isNull()
    unwrap = T.unwrap_or_unthink if g.thoughts else T.unwrap_or_whole
    letter = T.letter_standalone if g.thoughts else T.letter_leading
    said = F.flatten(F.zip_with("requests", "answers", lambda r, a: F.transform(a["texts"], lambda x: F.struct(r["kind"].alias("kind"), x.alias("x"), r["meant"].alias("meant")))))

    def values(kind: str, read: Callable[[Column], Column]) -> Column:
        got = F.array_compact(F.transform(F.filter(said, lambda v: v["kind"] == kind), read))
        return F.when(whole, got).otherwise(F.array().cast("array<string>"))

    def pick(v: Column) -> Column:
        return let(letter(unwrap(v["x"])), lambda l: F.when(l.isin(*T.LETTERS), F.try_element_at(v["meant"], F.ascii(l) - 64)))

    text = (lambda v: v["x"]) if g.raw else (lambda v: unwrap(v["x"]))
    out = rows.select("item", "task", form.cast("string").alias("form"), values("votes", lambda v: T.yes_no(unwrap(v["x"]))).alias("votes"), values("picks", pick).alias("picks"), values("samples", text).alias("samples"), F.coalesce(F.try_element_at(values("greedy", text), F.lit(1)), F.lit("")).alias("greedy"), (err if g.on_error == "item" else F.lit(None).cast("string")).alias("err"))
    return out.withColumn("done", F.lit(True))


def candidates(items: DataFrame, done: DataFrame | None, name: str, factory: Callable[[], Client], legend: str = "", seed: int = 0, retry_errors: bool = False, **calls) -> DataFrame:
    """The generator's rows for items of its tasks and forms that aren't done."""
    g = GENERATORS[name]
    work = items.filter(F.col("task").isin(*g.tasks())) if g.tasks() else items
    if g.forms:
        work = work.filter(F.col("form").isin(*g.forms))
    if done is not None:
        work = resume(work, done, retry_errors)
    return with_values(answered(with_requests(work, g, legend, seed), factory, fail_fast=g.on_error == "raise", **calls), g)
