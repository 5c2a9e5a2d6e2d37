"""Candidate generation behind an interface: filter and resume are relational, the model call is injected.

A client is a function (prompts) -> list of answers or exceptions, built once per partition by a factory, so
connections and models live with the Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.pools import resume

Client = Callable[[list[dict]], list]
SCHEMA = "item string, task string, samples array<string>, err string, done boolean"


def fake_client() -> Client:
    """Deterministic answers for tests: a digest of the prompt, the draw and the temperature."""

    def ask(calls: list[dict]) -> list:
        out = []
        for c in calls:
            seed = f"{c['prompt']}|{c['n']}|{c['temperature']}"
            if "FAIL" in c["prompt"]:
                out.append(RuntimeError("refused"))
            else:
                out.append([hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:8] for k in range(c["n"])])
        return out

    return ask


def digest_client() -> Client:
    """Deterministic answers to questions for tests: `Yes` or `No` by the first digit of the digest of prompt and draw, with
    the digest; to questions that ask for a letter one by the same digit."""

    def ask(calls: list[dict]) -> list:
        def say(prompt: str, k: int) -> str:
            m = hashlib.md5(f"{prompt}|{k}".encode()).hexdigest()
            if prompt.endswith("Answer with the letter."):
                return f"({'ABCD'[ord(m[0]) % 4]})."
            return f"{'Yes' if m[0] < '8' else 'No'} {m}"

        return [[say(c["prompt"], k) for k in range(c["n"])] for c in calls]

    return ask


def generate(work: DataFrame, done: DataFrame, factory: Callable[[], Client], n: int = 12, temperature: float = 0.8, keep_errors: bool = True, retry_errors: bool = False, fail_fast: bool = False) -> DataFrame:
    """work (item, task, prompt) not in done -> SCHEMA. An error is a finished row with err (keep_errors), no row, or
    ends the run (fail_fast)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for f in frames:
            got = ask([{"prompt": p or "", "n": n, "temperature": temperature} for p in f["prompt"]])
            rows = []
            for item, task, g in zip(f["item"], f["task"], got):
                if isinstance(g, Exception):
                    if fail_fast:
                        raise g
                    if keep_errors:
                        rows.append((item, task, [], str(g)[:200], True))
                else:
                    rows.append((item, task, list(g), None, True))
            yield pd.DataFrame(rows, columns=["item", "task", "samples", "err", "done"])

    return resume(work.select("item", "task", "prompt"), done, retry_errors).mapInPandas(run, SCHEMA)


def permuted(items: DataFrame, perms: list[list[int]]) -> DataFrame:
    """items (item, task, question) with four options -> one row per permutation: item, task, perm, prompt."""
    from corvane.functions import text as T

    p = T.question_parts(F.col("question"))
    rows = items.withColumn("p", p).filter("p.options is not null")
    q = [F.struct(F.lit(k).alias("perm"), T.permuted_question(F.col("p.stem"), F.col("p.options"), F.col("p.order"), x).alias("prompt")) for k, x in enumerate(perms)]
    return rows.select("item", "task", F.explode(F.array(*q)).alias("x")).select("item", "task", "x.*")
