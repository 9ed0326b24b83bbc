"""Per-region prompt text, built by one grouped aggregation.

Structure (what matters for a selector): a header with the candidate count,
then every member as ``[i]`` + its instruction and, when present, its input,
then the request with two example answers ``[1..k]`` and ``[k+1..2k]``.
The wording below is our own and lives in data, not code.

A region's text is one ``collect_list`` per region: regions are bounded by
construction (``region_size`` rows), so no group grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The "not available" marker some styles print for a NULL input,
# and the two answer formats a selector is asked for.
NULL_INPUT_MARK = "N\\A"
LIST_FORMAT = "[]"
RANKING_FORMAT = "[] > []"

STYLES: dict[str, dict] = {
    "simple": dict(
        header="You pick the {k} instructions whose human answers would teach a model the most.\n\n"
               "Below are {n} candidate instructions, each marked by a number in [].\n\n",
        null_input=None,
        request="Choose {k} of the instructions above by how much a labelled answer would add. "
                "Answer in the form [], e.g. {ex1} or {ex2}.\n\nThe {k} chosen identifiers:",
    ),
    "complex": dict(
        header="Below are {n} candidate instructions, each marked by a number in [].\n\n",
        null_input=None,
        request="Read the {n} numbered instructions. Pick {k} to send to annotators for fine-tuning data. "
                "Prefer ones that are clear, detailed and demanding, that differ from each other, "
                "and that would teach something new. Answer in the form [], e.g. {ex1} or {ex2}.\n\n"
                "The {k} chosen identifiers:",
    ),
    "complex_v2": dict(
        header="Below are {n} instructions that have no answer yet, each marked by a number in [].\n\n",
        null_input=NULL_INPUT_MARK,
        request="Pick the {k} instructions that would help a model most once annotated. Weigh: "
                "depth, breadth of topic, clarity, practical relevance and teaching value. "
                "Answer in the form [], e.g. {ex1} or {ex2}.\n\nThe {k} chosen identifiers:",
    ),
    "local": dict(
        header="Below are {n} instructions that have no answer yet, each marked by a number in [].\n\n",
        null_input=None,
        request="Read the {n} numbered instructions. Pick {k} to send to annotators for fine-tuning data. "
                "Prefer ones that are clear, detailed and demanding, that differ from each other, "
                "and that would teach something new. Answer in the form [], e.g. {ex1} or {ex2}.\n\n"
                "The {k} chosen identifiers:",
    ),
    "ranking": dict(
        header="Rank instructions by how much a human answer to each would help fine-tuning.\n\n"
               "Below are {n} instructions, each marked by a number in [].\n\n",
        null_input=NULL_INPUT_MARK,
        request="Rank all {n} instructions, most useful first, in the form [] > [], e.g. [1] > [2] > ...\n\n"
                "Ranking of the {n} identifiers:",
    ),
    "rationale": dict(
        header="Below are {n} instructions that have no answer yet, each marked by a number in [].\n\n",
        null_input=None,
        request="The instruction chosen from these {n} was [{chosen}]. "
                "Explain why it is a good pick for annotation.\n\nReason:",
    ),
}


def _fill(template: str, n: Column, k: Column, chosen: Column | None = None) -> Column:
    """Substitute {n} {k} {ex1} {ex2} {chosen} with column values."""
    ex1 = F.concat(F.lit("["), F.array_join(F.sequence(F.lit(1), k), ", "), F.lit("]"))
    ex2 = F.concat(F.lit("["), F.array_join(F.sequence(k + 1, k * 2), ", "), F.lit("]"))
    values = {"n": n.cast("string"), "k": k.cast("string"), "ex1": ex1, "ex2": ex2}
    if chosen is not None:
        values["chosen"] = chosen.cast("string")
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def _member_text(m: Column, null_input: str | None) -> Column:
    inp = m["input"]
    if null_input is None:
        input_block = F.when(inp.isNull(), F.lit("")).otherwise(
            F.concat(F.lit("### Input:\n "), inp, F.lit("\n\n")))
    else:
        input_block = F.concat(F.lit("### Input:\n "), F.coalesce(inp, F.lit(" " + null_input)),
                               F.lit("\n\n"))
    return F.concat(F.lit("["), (m["pos"] + 1).cast("string"), F.lit("]\n\n### Instruction:\n "),
                    F.coalesce(m["instruction"], F.lit("")), F.lit("\n\n"), input_block)


def region_prompts(members: DataFrame, k: int, style: str = "local",
                   chosen: DataFrame | None = None) -> DataFrame:
    """Build one prompt per region.

    ``members``: (region_id, pos, instruction, input). Returns
    (region_id, region_size, k, prompt). ``chosen`` (region_id, chosen_pos)
    feeds the rationale style (B6).
    """
    spec = STYLES[style]
    extra = [F.map_from_entries(F.collect_list(F.struct("pos", "row_id"))).alias("_ids")] \
        if "row_id" in members.columns else []
    grouped = members.groupBy("region_id").agg(
        F.count(F.lit(1)).cast("int").alias("region_size"),
        F.array_sort(F.collect_list(F.struct("pos", "instruction", "input"))).alias("_m"),
        *extra,
    )
    if chosen is not None:
        grouped = grouped.join(chosen, "region_id", "left")
    kk = F.lit(k)
    n = F.col("region_size")
    ch = (F.col("chosen_pos") + 1) if chosen is not None else None
    body = F.array_join(F.transform("_m", lambda m: _member_text(m, spec["null_input"])), "")
    prompt = F.concat(_fill(spec["header"], n, kk), body, _fill(spec["request"], n, kk, ch))
    keep = ["_ids"] if extra else []
    return grouped.select("region_id", "region_size", kk.alias("k"), prompt.alias("prompt"), *keep)
