"""Ask a selector about each region, parse, fall back, map back.

Two selectors:

- the built-in scorer (default, JVM-only): ranks a region's members by
  distinct-token count of instruction + input, ties by position, and writes
  its answer as text ``[i, j]`` exactly as a model would;
- any user ``Selector``: a function ``pandas.DataFrame(region_id, k,
  region_size, prompt) -> pandas.DataFrame(region_id, answer, in_tokens,
  out_tokens)`` run by ``mapInPandas`` on executors (one region per row,
  ``concurrency`` partitions cap parallel calls to a rate-limited service).

Either way the answer goes through the same parse (E9), fallback (Q15),
cut to k (T12) and top-up (Q17), then back to rows by (region_id, pos) (J3).
"""

from __future__ import annotations

import time
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selecta.functions.core import let
from selecta.functions.text import distinct_tokens, parse_id_list, parse_ranking, tokens
from selecta.operators.prompts import region_prompts

ANSWER_SCHEMA = "region_id int, answer string, in_tokens long, out_tokens long"

SelectorFn = Callable[[pd.DataFrame], pd.DataFrame]


def default_score(instruction="instruction", input_="input") -> Column:
    """Built-in selector score: distinct tokens of instruction + ' ' + input."""
    return distinct_tokens(F.concat_ws(" ", F.col(instruction), F.col(input_)))


def _ids_map() -> Column:
    """pos -> row_id of a region's members (bounded by the region size): the
    answers carry it, so picks map to rows without joining the members back."""
    return F.map_from_entries(F.collect_list(F.struct("pos", "row_id"))).alias("_ids")


def scorer_answers(members: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """Built-in selector: (region_id, region_size, answer, in_tokens, out_tokens).

    One grouped aggregate over (region_id, pos, score): rows are a few bytes,
    groups are bounded by the region size.
    """
    score = score if score is not None else default_score()
    scored = members.select("region_id", "pos", "row_id", score.alias("_score"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_score")).alias("s"), F.col("pos").alias("p")))),
                  1, k)
    agg = scored.groupBy("region_id").agg(F.count(F.lit(1)).cast("int").alias("region_size"),
                                          top.alias("_top"), _ids_map())
    answer = F.concat(F.lit("["), F.array_join(F.transform("_top", lambda t: (t["p"] + 1).cast("string")), ", "),
                      F.lit("]"))
    return agg.select("region_id", "region_size", "_ids", answer.alias("answer"),
                      F.lit(0).cast("long").alias("in_tokens"),
                      F.size(tokens(answer)).cast("long").alias("out_tokens"))


NO_ANSWER = "N/A"


def with_retry(call: SelectorFn, attempts: int = 5, first_wait: float = 0.5, longest_wait: float = 5.0,
               sleep: Callable[[float], None] = time.sleep) -> SelectorFn:
    """M4: a selector that calls ``call`` for one region at a time, waits and tries
    again when it raises (0.5 s, doubling to 5 s), and answers ``N/A`` when all
    ``attempts`` have failed. ``N/A`` does not parse, so the region falls back."""
    def safe(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i in range(len(batch)):
            row, wait = batch.iloc[i:i + 1], first_wait
            for attempt in range(attempts):
                try:
                    out.append(call(row))
                    break
                except Exception:  # noqa: BLE001 - whatever the user's service raises
                    if attempt + 1 < attempts:
                        sleep(wait)
                        wait = min(2 * wait, longest_wait)
            else:
                out.append(pd.DataFrame({"region_id": row["region_id"].values, "answer": [NO_ANSWER], "in_tokens": [0], "out_tokens": [0]}))
        return pd.concat(out, ignore_index=True) if out else batch.assign(answer=[], in_tokens=[], out_tokens=[])
    return safe


def run_selector(prompts: DataFrame, selector: SelectorFn, concurrency: int | None = None) -> DataFrame:
    """Apply a user selector to (region_id, region_size, k, prompt) on executors."""
    src = prompts.repartition(concurrency, "region_id") if concurrency else prompts

    def call(batches):
        for pdf in batches:
            out = selector(pdf[["region_id", "k", "region_size", "prompt"]])
            yield out[["region_id", "answer", "in_tokens", "out_tokens"]]

    answered = src.mapInPandas(call, ANSWER_SCHEMA)
    keep = ["region_id", "region_size"] + (["_ids"] if "_ids" in prompts.columns else [])
    # one row per region on both sides
    return answered.join(prompts.select(*keep), "region_id")


def resolve_positions(answers: DataFrame, k: int, fallback_offset: int = 0,
                      top_up: bool = True) -> DataFrame:
    """Parse answers into k positions per region: (region_id, pick, pos, parsed).

    ``parsed`` is false where the fallback was used.
    """
    rs = F.col("region_size")
    ids = parse_id_list(F.col("answer"), rs)
    fallback = F.filter(F.sequence(F.lit(fallback_offset), F.lit(fallback_offset + k - 1)),
                        lambda x: x < rs)
    chosen = F.slice(F.coalesce(ids, fallback), 1, k)
    if top_up:
        def fill(c: Column) -> Column:
            rest = F.filter(F.sequence(F.lit(0), rs - 1), lambda x: ~F.array_contains(c, x))
            return F.slice(F.concat(c, rest), 1, k)
        chosen = let(chosen, fill)
    carry = ["_ids"] if "_ids" in answers.columns else []
    out = answers.select(
        "region_id", *carry, ids.isNotNull().alias("parsed"),
        F.posexplode(chosen).alias("pick", "pos"),
    ).select("region_id", F.col("pick").cast("int").alias("pick"), F.col("pos").cast("int").alias("pos"),
             "parsed", *carry)
    if carry:
        out = out.withColumn("row_id", F.element_at("_ids", F.col("pos"))).drop("_ids")
    return out


def local_select(members: DataFrame, k: int, selector: SelectorFn | None = None,
                 style: str = "local", fallback_offset: int = 0, concurrency: int | None = None,
                 score: Column | None = None) -> DataFrame:
    """K rows per region. ``members``: (region_id, pos, row_id, instruction, input, ...).

    Returns (region_id, pos, row_id, pick, parsed): ``pick`` is 0..k-1 in
    answer order. Row ids come from the region aggregate itself, so the
    members are ranked and shuffled once; fetch other columns with a join of
    this n-row result on row_id (J3).
    """
    if selector is None:
        answers = scorer_answers(members, k, score)
    else:
        prompts = region_prompts(members, k, style)
        answers = run_selector(prompts, selector, concurrency)
    return resolve_positions(answers, k, fallback_offset)


def prompts_answers(members: DataFrame, k: int, selector: SelectorFn, style: str = "local",
                    concurrency: int | None = None) -> DataFrame:
    """Build the region prompts and run a user selector on them: the answer
    table (region_id, answer, in_tokens, out_tokens, region_size)."""
    return run_selector(region_prompts(members, k, style), selector, concurrency)


def token_usage(answers: DataFrame) -> DataFrame:
    """Totals of selector tokens."""
    return answers.agg(F.sum("in_tokens").cast("long").alias("in_tokens"),
                       F.sum("out_tokens").cast("long").alias("out_tokens"),
                       F.count(F.lit(1)).alias("n_calls"))


def list_rank_pick(members: DataFrame, answers: DataFrame, which: str = "first") -> DataFrame:
    """A full ranking per region; keep its first / center / last member.

    ``answers``: (region_id, region_size, answer). A malformed ranking, or one
    that is not a permutation of the region, falls back to identity order.
    """
    rs = F.col("region_size")
    order = parse_ranking(F.col("answer"))
    ident = F.sequence(F.lit(0), rs - 1)
    is_perm = order.isNotNull() & (F.size(order) == rs) & \
        (F.array_sort(F.coalesce(order, F.array().cast("array<int>"))) == ident)
    final = F.when(is_perm, order).otherwise(ident)
    index = {"first": F.lit(1), "center": F.floor(rs / 2).cast("int") + 1, "last": rs}[which]
    picked = answers.select("region_id", F.element_at(final, index).alias("pos"), is_perm.alias("parsed"))
    return members.join(picked, ["region_id", "pos"])


_MEMBER = None


def longest_instruction_selector(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for a model: reads only the prompt text, picks
    the k members whose instruction is longest (ties: first listed) and
    answers in the requested '[i, j]' form. Token counts are whitespace words."""
    import re
    global _MEMBER
    if _MEMBER is None:
        _MEMBER = re.compile(r"\[(\d+)\]\n\n### Instruction:\n (.*?)\n\n(?=### Input:|\[\d+\]\n\n### Instruction:|[^\[#])",
                             re.S)
    answers, tin, tout = [], [], []
    for prompt, k in zip(batch["prompt"], batch["k"]):
        members = [(int(m.group(1)), m.group(2)) for m in _MEMBER.finditer(prompt)]
        ranked = sorted(members, key=lambda t: (-len(t[1]), t[0]))[: int(k)]
        ans = "[" + ", ".join(str(i) for i, _ in ranked) + "]"
        answers.append(ans)
        tin.append(len(prompt.split()))
        tout.append(len(ans.split()))
    return pd.DataFrame({"region_id": batch["region_id"].astype("int32").values, "answer": answers,
                         "in_tokens": tin, "out_tokens": tout})
