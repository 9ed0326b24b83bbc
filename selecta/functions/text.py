"""Text column expressions. All JVM-side (codegen'd), no Python per row.

Whitespace: Python's ``str.split()`` / ``str.strip()`` use Unicode
whitespace; here the class is ASCII ``[ \\t\\n\\r\\f\\v]`` (Java ``\\s``). The
test tables hold no other whitespace, so results agree; say so for other data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from selecta.functions.core import let

# Token separator class and the sentence pattern (no
# look-behind, so DuckDB's RE2 accepts the same pattern).
TOKEN_SEPARATOR = r"[ \t\n\r]+"
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"

# Training and inference templates (literal formats the
# downstream model was trained on; the inference one keeps its indentation).
TRAIN_TEMPLATE = "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n{output}\n"
INFER_INDENT = " " * 12
INFER_TEMPLATE = (
    "### Instruction:\n" + INFER_INDENT + "{instruction}\n\n"
    + INFER_INDENT + "### Input:\n" + INFER_INDENT + "{input}\n\n"
    + INFER_INDENT + "### Response:\n" + INFER_INDENT
)
EMBED_INSTRUCTION = "### Instruction: "
EMBED_INPUT = "\n\n### Input: "
EMBED_RESPONSE = "\n\n### Response:"
RESPONSE_MARKER = "### Response:"
BLANK_PREDICTION = "dummy string"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Whitespace tokens, empty strings dropped (``str.split()``).

    Same tokens as splitting on TOKEN_SEPARATOR, but ``translate`` maps
    tab / newline / CR to a space char by char and the split is on one
    literal space (Java's non-regex fast path): about 3x faster.
    """
    spaced = F.translate(_c(text), "\t\n\r", "   ")
    return F.filter(F.split(spaced, " "), lambda t: t != F.lit(""))


def ngrams(text, n: int) -> Column:
    """Adjacent token n-grams joined by one space (tokens hold no spaces).

    Built from n shifted slices combined by ``zip_with`` (O(tokens)); a
    lambda that indexes the token array would re-split the text per element.
    ``zip_with`` pads the shorter side with NULL, so the incomplete tail
    n-grams are NULL and filtered out (fewer than n tokens -> empty array).
    """
    if n == 1:
        return tokens(text)

    def build(t: Column) -> Column:
        size = F.size(t)
        acc = t
        for j in range(1, n):
            shifted = F.slice(t, j + 1, F.greatest(size - j, F.lit(0)))
            acc = F.zip_with(acc, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(acc, lambda x: x.isNotNull())

    return let(tokens(text), build)


def bigrams(text) -> Column:
    return ngrams(text, 2)


def distinct_tokens(text) -> Column:
    return F.size(F.array_distinct(tokens(text))).cast("long")


def strip(text) -> Column:
    """``str.strip()`` (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def collapse_ws(text) -> Column:
    return F.regexp_replace(_c(text), r"\s+", " ")


def sentence_concat(instruction, input_) -> Column:
    """Instruction + ' ' + input, stripped, whitespace runs collapsed."""
    joined = F.concat(F.coalesce(_c(instruction), F.lit("")), F.lit(" "),
                      F.coalesce(_c(input_), F.lit("")))
    return collapse_ws(strip(joined))


def sentence_stripped(instruction, input_) -> Column:
    """strip(instruction) + ' ' + strip(input), stripped (no collapse)."""
    joined = F.concat(strip(F.coalesce(_c(instruction), F.lit(""))), F.lit(" "),
                      strip(F.coalesce(_c(input_), F.lit(""))))
    return strip(joined)


def prompt_nullprop(instruction, input_) -> Column:
    """Instruction + ' ' + input, NULL when input is NULL (Q3), stripped."""
    return strip(F.concat(_c(instruction), F.lit(" "), _c(input_)))


def prompt_optional_input(instruction, input_) -> Column:
    """P10: instruction, plus ' ' + input only when input is non-empty."""
    inp = F.coalesce(_c(input_), F.lit(""))
    return F.when(inp != "", F.concat(_c(instruction), F.lit(" "), inp)).otherwise(_c(instruction))


def template_train(instruction, input_, output) -> Column:
    """The training text (nulls printed as empty)."""
    return F.concat(
        F.lit("### Instruction:\n"), F.coalesce(_c(instruction), F.lit("")),
        F.lit("\n\n### Input:\n"), F.coalesce(_c(input_), F.lit("")),
        F.lit("\n\n### Response:\n"), F.coalesce(_c(output), F.lit("")), F.lit("\n"),
    )


def template_infer(instruction, input_) -> Column:
    """The inference text, without output, indentation kept."""
    return F.concat(
        F.lit("### Instruction:\n" + INFER_INDENT), F.coalesce(_c(instruction), F.lit("")),
        F.lit("\n\n" + INFER_INDENT + "### Input:\n" + INFER_INDENT), F.coalesce(_c(input_), F.lit("")),
        F.lit("\n\n" + INFER_INDENT + "### Response:\n" + INFER_INDENT),
    )


def template_embed(instruction, input_) -> Column:
    """Text to encode; the Input block only when input is not NULL."""
    return F.concat(
        F.lit(EMBED_INSTRUCTION), F.coalesce(_c(instruction), F.lit("")),
        F.when(_c(input_).isNotNull(), F.concat(F.lit(EMBED_INPUT), _c(input_))).otherwise(F.lit("")),
        F.lit(EMBED_RESPONSE),
    )


def extract_response(text) -> Column:
    """Text after the response marker (DOTALL), else the whole text; stripped."""
    found = F.regexp_extract(_c(text), r"(?s)### Response:\s*(.*)", 1)
    has = _c(text).contains(RESPONSE_MARKER)
    return strip(F.when(has, found).otherwise(_c(text)))


def strip_prompt_prefix(text, prompt) -> Column:
    """Drop the first length(prompt) characters."""
    return F.substr(_c(text), F.length(_c(prompt)) + 1)


def remove_prompt(text, prompt) -> Column:
    """Remove every occurrence of the prompt, then strip."""
    return strip(F.when(F.length(_c(prompt)) > 0, F.replace(_c(text), _c(prompt), F.lit("")))
                 .otherwise(_c(text)))


def dummy_fill(text) -> Column:
    """P18 (Q10): a prediction with no tokens becomes 'dummy string'."""
    return F.when(F.size(tokens(F.coalesce(_c(text), F.lit("")))) == 0, F.lit(BLANK_PREDICTION)) \
        .otherwise(_c(text))


def sentences(text) -> Column:
    """Regex sentence split, trimmed, non-empty."""
    parts = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(SENTENCE_PATTERN), 0)
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != F.lit(""))


def parse_id_list(answer, region_size) -> Column:
    """E9: '[3, 1]' -> [2, 0] (1-based to 0-based), first occurrence kept.

    Valid only when the trimmed answer is one bracketed list of integers;
    ids outside 1..region_size are dropped (Q16). Anything else -> NULL,
    which callers turn into the fallback positions (Q15).
    """
    a = strip(_c(answer))
    valid = a.rlike(r"^\[\s*[0-9]+(\s*,\s*[0-9]+)*\s*\]$")
    ids = F.transform(F.regexp_extract_all(a, F.lit(r"([0-9]+)"), 1),
                      lambda x: x.cast("int") - 1)
    rs = region_size if isinstance(region_size, Column) else F.lit(region_size)
    ids = F.array_distinct(F.filter(ids, lambda x: (x >= 0) & (x < rs)))
    return F.when(valid, ids)


def parse_ranking(answer) -> Column:
    """E10: '[2] > [5] > [1]' -> [1, 4, 0]; any malformed item -> NULL."""
    items = F.transform(F.split(F.coalesce(_c(answer), F.lit("")), ">"),
                        lambda s: F.regexp_replace(s, r"^[ \[]+|[ \]]+$", ""))
    ok = F.forall(items, lambda s: s.rlike(r"^[0-9]+$"))
    return F.when(ok, F.transform(items, lambda s: s.cast("int") - 1))
