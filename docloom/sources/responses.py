"""Requests to and answers from a responder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.exprs import let, materialise, strip_unicode
from docloom.schemas import RESPONSE_BODY, RESPONSES

INSTRUCTIONS = (
    "Read the business document below. Return one JSON object with the keys template_id, "
    "fingerprint (required_keywords, supplier_hint, doc_type, keyword_quorum), extraction_rules "
    "(field, type, regex with one capture group, or anchor_regex, stop_regex and columns for a "
    "table, date_format), confidence_checks (field, not_null, gt, lt, regex_match) and "
    "extracted_data (one value per field)."
)
FENCE = "```"


def build_requests(
    docs: DataFrame,
    max_chars: int | None = EngineConfig.prompt_max_chars,
    instructions: str = INSTRUCTIONS,
) -> DataFrame:
    """S12. One prompt per document: instructions, the template to keep if there is one, the text.

    ``docs``: doc_id, full_text, existing_template_id. ``max_chars`` None sends the text whole.
    """
    text = F.col("full_text") if max_chars is None else F.substring("full_text", 1, max_chars)
    hint = F.when(
        F.col("existing_template_id").isNotNull(),
        F.concat(
            F.lit("\n\nThe store already holds template "),
            F.col("existing_template_id"),
            F.lit(" for this kind of document; keep this template_id and extend it."),
        ),
    ).otherwise(F.lit(""))
    truncated = F.lit(False) if max_chars is None else F.length("full_text") > max_chars
    return docs.select(
        "doc_id",
        "existing_template_id",
        F.concat(
            F.lit(instructions), hint, F.lit("\n\nDocument text:\n---\n"), text, F.lit("\n---\n\nAnswer with the JSON object only.")
        ).alias("prompt"),
        truncated.alias("truncated"),
    )


def question_prompts(
    questions: DataFrame, results: DataFrame, max_chars: int = EngineConfig.chat_max_chars
) -> DataFrame:
    """P11. (doc_id, question) joined to (doc_id, data_json, full_text): one prompt per question."""
    return questions.join(results.select("doc_id", "data_json", "full_text"), "doc_id").select(
        "doc_id",
        "question",
        F.concat(
            F.lit("Extracted fields:\n"),
            F.col("data_json"),
            F.lit("\n\nDocument text:\n"),
            F.substring("full_text", 1, max_chars),
            F.lit("\n\nQuestion: "),
            F.col("question"),
        ).alias("prompt"),
    )


Responder = Callable[[pd.DataFrame], pd.DataFrame]


def ask(requests: DataFrame, responder: Responder) -> DataFrame:
    """R7. Run a user-supplied responder over request batches; it returns RESPONSES rows."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield responder(frame)

    return requests.mapInPandas(batches, RESPONSES)


def unfence(raw: Column) -> Column:
    """S11. Strip; drop an opening fence line and everything from the last fence on."""

    def cut(v: Column) -> Column:
        first_break = F.locate("\n", v)
        body = F.when(first_break > 0, F.substring(v, first_break + 1, F.length(v))).otherwise(v)
        return F.when(v.startswith(FENCE), F.regexp_replace(body, r"(?s)```(?!.*```).*\z", "")).otherwise(v)

    return let(strip_unicode(raw), cut)


def decode_responses(responses: DataFrame, empty_is_object: Column | None = None) -> DataFrame:
    """S11. Adds ``body`` (decoded struct), ``data_json`` (extracted_data as given, with its JSON types) and
    ``reject`` (why a response is unusable, else null). Numbers may be given as text.

    ``empty_is_object``: where true, a missing or empty answer counts as ``{}``.
    """
    raw = F.coalesce("raw", F.lit(""))
    if empty_is_object is not None:
        raw = F.when(empty_is_object & (raw == ""), F.lit("{}")).otherwise(raw)
    text = materialise(responses, _text=unfence(raw))
    parsed = materialise(
        text,
        body=F.from_json(
            "_text",
            f"{RESPONSE_BODY}, _corrupt string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
        ),
    )
    body = F.col("body")
    quorum = body["fingerprint"]["keyword_quorum"].try_cast("double")
    numbers = lambda k: (k["gt"].isNotNull() & k["gt"].try_cast("double").isNull()) | (
        k["lt"].isNotNull() & k["lt"].try_cast("double").isNull()
    )
    reject = (
        F.when(
            body.isNull() | body["_corrupt"].isNotNull() | ~F.coalesce(F.ltrim("_text"), F.lit("")).startswith("{"),
            F.lit("malformed JSON"),
        )
        .when(F.exists(body["extraction_rules"], lambda r: r["field"].isNull()), F.lit("rule without field"))
        .when(F.exists(body["confidence_checks"], lambda c: c["field"].isNull()), F.lit("check without field"))
        .when((quorum < 0) | (quorum > 1), F.lit("keyword_quorum outside [0, 1]"))
        .when(
            (body["fingerprint"]["keyword_quorum"].isNotNull() & quorum.isNull())
            | F.exists(body["confidence_checks"], numbers),
            F.lit("a number is expected"),
        )
    )
    return parsed.withColumns(
        {"reject": reject, "data_json": F.get_json_object("_text", "$.extracted_data")}
    ).drop("_text")
