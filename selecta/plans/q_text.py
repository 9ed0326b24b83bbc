"""Queries: text projections, templates and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from selecta.functions import text as tx
from selecta.plans.registry import query
from selecta.plans.sqlbits import INSTR, PAIRS, PREDS, strip, tok, with_
from selecta.sources.views import instr, pairs, preds

NL = "chr(10)"
IND = "'" + " " * 12 + "'"


@query("sentence_concat", oracle=with_(PAIRS) + f"""
SELECT row_id, regexp_replace({strip("coalesce(instruction, '') || ' ' || coalesce(input, '')")}, '\\s+', ' ', 'g') AS sentence
FROM pairs""")
def q_sentence_concat(spark, sf_dir):
    """P7."""
    return pairs(spark, sf_dir).select("row_id", tx.sentence_concat("instruction", "input").alias("sentence"))


@query("sentence_stripped", oracle=with_(PAIRS) + f"""
SELECT row_id, {strip(strip("coalesce(instruction, '')") + " || ' ' || " + strip("coalesce(input, '')"))} AS sentence
FROM pairs""")
def q_sentence_stripped(spark, sf_dir):
    """P8."""
    return pairs(spark, sf_dir).select("row_id", tx.sentence_stripped("instruction", "input").alias("sentence"))


@query("prompt_nullprop", oracle=with_(PAIRS) + f"""
SELECT row_id, {strip("instruction || ' ' || input")} AS prompt FROM pairs""")
def q_prompt_nullprop(spark, sf_dir):
    """P9 (Q3): NULL input gives a NULL prompt."""
    return pairs(spark, sf_dir).select("row_id", tx.prompt_nullprop("instruction", "input").alias("prompt"))


@query("prompt_optional_input", oracle=with_(PAIRS) + """
SELECT row_id, CASE WHEN coalesce(input, '') <> '' THEN instruction || ' ' || input ELSE instruction END AS prompt
FROM pairs""")
def q_prompt_optional_input(spark, sf_dir):
    """P10."""
    return pairs(spark, sf_dir).select("row_id", tx.prompt_optional_input("instruction", "input").alias("prompt"))


TRAIN_SQL = (f"'### Instruction:' || {NL} || coalesce(instruction, '') || {NL} || {NL} || '### Input:' || {NL} "
             f"|| coalesce(input, '') || {NL} || {NL} || '### Response:' || {NL} || coalesce(output, '') || {NL}")
INFER_SQL = (f"'### Instruction:' || {NL} || {IND} || coalesce(instruction, '') || {NL} || {NL} || {IND} || "
             f"'### Input:' || {NL} || {IND} || coalesce(input, '') || {NL} || {NL} || {IND} || '### Response:' || {NL} || {IND}")


@query("template_train", oracle=with_(PAIRS) + f"SELECT row_id, {TRAIN_SQL} AS text FROM pairs")
def q_template_train(spark, sf_dir):
    """P12."""
    return pairs(spark, sf_dir).select("row_id", tx.template_train("instruction", "input", "output").alias("text"))


@query("template_infer", oracle=with_(PAIRS) + f"SELECT row_id, {INFER_SQL} AS text FROM pairs")
def q_template_infer(spark, sf_dir):
    """P13."""
    return pairs(spark, sf_dir).select("row_id", tx.template_infer("instruction", "input").alias("text"))


@query("template_embed", oracle=with_(PAIRS) + f"""
SELECT row_id, '### Instruction: ' || coalesce(instruction, '') ||
  CASE WHEN input IS NOT NULL THEN {NL} || {NL} || '### Input: ' || input ELSE '' END
  || {NL} || {NL} || '### Response:' AS text FROM pairs""")
def q_template_embed(spark, sf_dir):
    """The Input block only for a non-NULL input."""
    return pairs(spark, sf_dir).select("row_id", tx.template_embed("instruction", "input").alias("text"))


def _extract_sql(x: str) -> str:
    return (f"{strip(f'CASE WHEN contains({x}, {chr(39)}### Response:{chr(39)}) THEN '
                     f'regexp_extract({x}, {chr(39)}(?s)### Response:\\s*(.*){chr(39)}, 1) ELSE {x} END')}")


@query("extract_response", oracle=with_(PAIRS) + f"""
SELECT row_id, {_extract_sql("(" + TRAIN_SQL + ")")} AS from_template, {_extract_sql("output")} AS from_plain
FROM pairs""")
def q_extract_response(spark, sf_dir):
    """P15 on a formatted text (marker present) and on a plain one (absent)."""
    p = pairs(spark, sf_dir)
    return p.select("row_id",
                    tx.extract_response(tx.template_train("instruction", "input", "output")).alias("from_template"),
                    tx.extract_response("output").alias("from_plain"))


@query("strip_prompt_prefix", oracle=with_(PAIRS) + f"""
SELECT row_id, substring(generated, length(prompt) + 1) AS response
FROM (SELECT row_id, {INFER_SQL} AS prompt, {INFER_SQL} || output AS generated FROM pairs)""")
def q_strip_prompt_prefix(spark, sf_dir):
    """A generation echoes its prompt; drop it by length."""
    p = pairs(spark, sf_dir).select(
        "row_id", tx.template_infer("instruction", "input").alias("prompt"), "output")
    return p.select("row_id", tx.strip_prompt_prefix(F.concat("prompt", "output"), "prompt").alias("response"))


@query("remove_prompt", oracle=with_(PAIRS) + f"""
SELECT row_id, {strip("CASE WHEN length(instruction) > 0 THEN replace(generated, instruction, '') ELSE generated END")} AS response
FROM (SELECT row_id, instruction, instruction || ' ' || output || ' ' || instruction AS generated FROM pairs)""")
def q_remove_prompt(spark, sf_dir):
    """Every occurrence of the prompt removed, stripped."""
    p = pairs(spark, sf_dir).select(
        "row_id", "instruction",
        F.concat_ws(" ", "instruction", "output", "instruction").alias("generated"))
    return p.select("row_id", tx.remove_prompt("generated", "instruction").alias("response"))


@query("dummy_fill", oracle=with_(PREDS) + f"""
SELECT row_id, seed, CASE WHEN len({tok("coalesce(pred, '')")}) = 0 THEN 'dummy string' ELSE pred END AS pred
FROM preds""")
def q_dummy_fill(spark, sf_dir):
    """P18 (Q10)."""
    return preds(spark, sf_dir).select("row_id", "seed", tx.dummy_fill("pred").alias("pred"))


@query("sentence_split", oracle=with_(INSTR) + f"""
SELECT row_id, list_filter(list_transform(regexp_extract_all(coalesce(instruction || ' ' || coalesce(input, ''), ''),
  '[^.!?\\n]+[.!?]*'), lambda s: {strip("s")}), lambda s: s <> '') AS sentences FROM instr""")
def q_sentence_split(spark, sf_dir):
    """Regex sentence segmentation of instruction + input."""
    i = instr(spark, sf_dir)
    return i.select("row_id", tx.sentences(F.concat(F.col("instruction"), F.lit(" "),
                                                    F.coalesce("input", F.lit("")))).alias("sentences"))
