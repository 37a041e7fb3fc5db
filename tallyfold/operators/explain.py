"""Texts around explanations: prompts, retrieval queries, parsing of responses and judge scores, checks against the payment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A number with an optional thousands suffix, an account id, and fields of a broken response.
NUMBER = r"\$?([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)\s*([Kk])?"
ACCOUNT = r"[A-Z]\d{7,}"
TEXT_FIELD = r'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"'
CONFIDENCE = r'"confidenceScore"\s*:\s*([0-9.]+)'
INCOMPLETE_SUMMARY = "Partial LLM response (truncated)"
INCOMPLETE_ACTION = "Manual review recommended — LLM response was incomplete"
QUERY_SUFFIX = "fraud anomaly suspicious transaction"
TOLERANCE = 0.2


# checks


def amount_mentioned(text: Column, amount: Column) -> Column:
    """Whether the text names the amount in some notation, or any number within 20 % of it (a suffix K counts thousands)."""
    grouped = F.regexp_replace(F.format_number(amount, 2), r"(\.00|0)$", "")
    thousands = F.round(amount / 1000, 0).cast("long")
    notations = [amount.cast("string"), F.round(amount, 0).cast("decimal(18,0)").cast("string"), grouped, F.format_number(amount, 0)]
    exact = [text.contains(n) for n in notations]
    in_k = (thousands > 0) & F.lower(text).contains(F.concat(thousands.cast("string"), F.lit("k")))
    target = amount.cast("double")

    def close(found: Column) -> Column:
        value = F.replace(F.regexp_extract(found, NUMBER, 1), F.lit(","), F.lit("")).cast("double") * F.when(found.rlike("[Kk]$"), 1000).otherwise(1)
        return value.between(target * (1.0 - TOLERANCE), target * (1.0 + TOLERANCE))

    return exact[0] | exact[1] | exact[2] | exact[3] | in_k | F.exists(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), close)


def _amount_flag() -> Column:
    text = F.concat(F.coalesce("explanation_text", F.lit("")), F.coalesce(F.concat(F.lit(" "), F.col("risk_summary")), F.lit("")))
    missing = F.col("amount").isNotNull() & (F.trim(text) != "") & ~amount_mentioned(text, F.col("amount"))
    return F.when(missing, F.lit("AMOUNT_NOT_REFERENCED"))


def _account_flag() -> Column:
    text, low = F.col("explanation_text"), F.lower("explanation_text")
    speaks = low.contains("sender") | low.contains("receiver") | low.contains("account")
    cites = text.contains(F.col("sender_account")) | text.contains(F.col("receiver_account"))  # null ids: no flag
    return F.when(speaks & ~cites & text.rlike(ACCOUNT), F.lit("POSSIBLE_ACCOUNT_FABRICATION"))


def validate_amount(rows: DataFrame) -> DataFrame:
    """id, flag: AMOUNT_NOT_REFERENCED if neither explanation_text nor risk_summary names the amount; null without amount or text."""
    return rows.select("id", _amount_flag().alias("flag"))


def validate_accounts(rows: DataFrame) -> DataFrame:
    """id, flag: POSSIBLE_ACCOUNT_FABRICATION if the text speaks of accounts and cites an id, but neither the sender nor the receiver."""
    return rows.select("id", _account_flag().alias("flag"))


def _flag(name: str, when: Column) -> Column:
    return F.when(when, F.lit(name))


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def _says(*phrases: str) -> Column:
    low = F.lower("explanation_text")
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: low.contains(p))


#: The names of the flags, and the phrases that speak against, or for, fraud.
LOW_RISK, CERTAIN = ("low risk", "unlikely fraud"), ("certainly fraud", "definitely fraudulent")


def _checks() -> dict[str, Column]:
    """Every check's flag, or null, in the order in which they are made."""
    score, confidence = F.col("ml_risk_score"), F.col("confidence_score")
    return {
        "empty_risk_summary": _flag("EMPTY_RISK_SUMMARY", _blank("risk_summary")),
        "empty_explanation_text": _flag("EMPTY_EXPLANATION_TEXT", _blank("explanation_text")),
        "empty_suspicious_patterns": _flag("EMPTY_SUSPICIOUS_PATTERNS", F.coalesce("n_patterns", F.lit(0)) == 0),
        "empty_recommended_actions": _flag("EMPTY_RECOMMENDED_ACTIONS", F.coalesce("n_actions", F.lit(0)) == 0),
        "confidence": _flag("CONFIDENCE_OUT_OF_RANGE", ~confidence.between(0, 1)),
        "amount": _amount_flag(),
        "accounts": _account_flag(),
        "mismatch": _flag("RISK_DIRECTION_MISMATCH", (score > 0.9) & _says(*LOW_RISK)),
        "overclaim": _flag("RISK_OVERCLAIM", (score < 0.6) & _says(*CERTAIN)),
    }


def check(rows: DataFrame, **names: str) -> DataFrame:
    """id and the flags of some checks: column name -> check (see _checks)."""
    made = _checks()
    return rows.select("id", *[made[c].alias(n) for n, c in names.items()])


def validate(rows: DataFrame) -> DataFrame:
    """rows with flags (of all nine checks), hallucination_free (no flag) and the explanation type that follows: retrieval-based
    ones without a flag are validated."""
    seen = rows.withColumn("flags", F.array_compact(F.array(*_checks().values()))).withColumn("hallucination_free", F.size("flags") == 0)
    return seen.withColumn("explanation_type", F.when((F.col("explanation_type") == "LLM_RAG") & F.col("hallucination_free"), "LLM_RAG_VALIDATED").otherwise(F.col("explanation_type")))


#: Scores from which an alert is explained directly, and with retrieved patterns.
DIRECT_FROM, RAG_FROM = 0.5, 0.75


def route(alerts: DataFrame) -> DataFrame:
    """id, route (SKIP, DIRECT, RAG) by configuration and score, effective_type (what the score calls for; alerts of rules alone have
    none and get retrieval)."""
    score = F.col("ml_risk_score")
    by_score = F.when(score.isNull() | (score >= RAG_FROM), "RAG").when(score >= DIRECT_FROM, "DIRECT").otherwise("SKIP")
    explained = ~F.col("detection_config").isin("RULES_ONLY", "ML_ONLY")
    kind = F.when(by_score != "SKIP", F.concat(F.lit("LLM_"), by_score))
    return alerts.select("id", F.when(explained, by_score).otherwise("SKIP").alias("route"), kind.alias("effective_type"))


def retrieval_keys(alerts: DataFrame, tx: DataFrame) -> DataFrame:
    """The distinct pairs of triggered rules and kind of payment: one retrieval serves all alerts of a pair."""
    kinds = tx.select(F.col("id").alias("transaction_id"), "transaction_type")
    return alerts.where("rule_triggered IS NOT NULL").join(kinds, "transaction_id").select("rule_triggered", "transaction_type").distinct()


# texts for retrieval and prompts


def retrieval_query(rows: DataFrame, *kept: str) -> DataFrame:
    """id, columns to be kept, query_text: names of the triggered rules, the kind of payment and fixed search terms. rows: id,
    rule_triggered, transaction_type."""
    spoken = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    rules = F.transform(F.split("rule_triggered", ";"), lambda p: spoken(F.trim(F.element_at(F.split(p, ":"), 1))))
    named = F.when(F.trim("rule_triggered") != "", F.array_join(rules, " "))
    return rows.select("id", *kept, F.concat_ws(" ", named, spoken(F.col("transaction_type")), F.lit(QUERY_SUFFIX)).alias("query_text"))


def template() -> Column:
    """The prompt's focus: the first signal that applies, by the rules or the features."""
    rules = F.upper(F.coalesce("rule_triggered", F.lit("")))
    return (
        F.when(rules.contains("VELOCITY") | rules.contains("RAPID") | (F.col("tx_velocity_1h") > 3), "VELOCITY")
        .when(rules.contains("STRUCTURING") | (F.col("is_round_amount") & (F.col("tx_velocity_24h") > 2)), "STRUCTURING")
        .when(rules.contains("NEW_RECEIVER") | F.col("is_new_receiver"), "NEW_RECEIVER")
        .when(rules.contains("LARGE") | (F.col("amount_zscore") > 2.0), "LARGE_AMOUNT")
        .otherwise("GENERIC")
    )


#: Labels of the prompt's feature lines, and the decimals of those that are rounded.
FEATURE_LINES = {
    "amount_zscore": ("Amount Z-Score", 2), "tx_velocity_1h": ("Transaction Velocity (1h)", None), "tx_velocity_24h": ("Transaction Velocity (24h)", None),
    "avg_amount_7d": ("Average Amount (7d)", None), "amount_ratio_to_avg": ("Amount/Average Ratio", 2), "is_new_receiver": ("New Receiver", None),
    "receiver_diversity_7d": ("Receiver Diversity (7d)", None), "is_round_amount": ("Round Amount", None), "is_high_risk_type": ("High Risk Type", None),
}


#: The heading of retrieved patterns in a prompt, that of each one, and what is said after them.
KNOWN_HEADING, KNOWN_PATTERN = "## Relevant Fraud Patterns from Knowledge Base", "### Pattern "
KNOWN_CLOSING = "Use the above fraud patterns as reference context when they are relevant to the transaction being analyzed. Cite specific patterns if they match the observed behavior."


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: "), value.cast("string"))  # null if the value is, and then left out


def prompt_table(rows: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """id, template, prompt for every alert. rows: alerts with their payment and features, and, if patterns were retrieved, their
    text in a column context; or context (id, context) is joined."""
    payment = [_line("Amount", F.col("amount")), _line("Type", F.col("transaction_type")), _line("Sender", F.col("sender_account")), _line("Receiver", F.col("receiver_account")), _line("Sender Balance Before", F.col("sender_balance_before"))]
    measured = [_line(label, F.col(c) if places is None else F.format_string(f"%.{places}f", c)) for c, (label, places) in FEATURE_LINES.items()]
    measured = [F.when(F.col(c).isNotNull(), m) for c, m in zip(FEATURE_LINES, measured, strict=True)]
    scored = F.when(F.col("ml_risk_score").isNotNull(), _line("ML Risk Score", F.format_string("%.4f", "ml_risk_score")))
    signals = [_line("Detection Config", F.col("detection_config")), _line("Rules Triggered", F.nullif(F.trim("rule_triggered"), F.lit(""))), scored]
    parts = [F.lit("## Transaction Details"), *payment, F.lit("## Computed Features"), *measured, F.lit("## Detection Signals"), *signals]
    rows = rows if context is None else rows.join(context, "id", "left")
    if "context" in rows.columns:
        told = F.col("context").isNotNull()
        parts += [F.when(told, F.lit(f"\n{KNOWN_HEADING}")), F.col("context"), F.when(told, F.lit(f"\n{KNOWN_CLOSING}"))]
    return rows.select("id", template().alias("template"), F.concat_ws("\n", *parts).alias("prompt"))


# responses


def unfenced(raw: Column) -> Column:
    """The text without white space and code fences around it."""
    return F.regexp_replace(F.regexp_replace(raw, r"^\s*```(json)?\s*|^\s+", ""), r"\s*```\s*$|\s+$", "")


def closed(text: str | None) -> str | None:
    """A JSON text cut off in the middle with its open string and brackets closed; None if none is open."""
    if text is None or not text.startswith("{"):
        return None
    open_, quoted, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif c == "\\" and quoted:
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            open_.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and open_:
            open_.pop()
    if not (open_ or quoted):
        return None
    body = text[:-1] if skip else text
    return (body + '"' if quoted else body.rstrip().rstrip(",")) + "".join(reversed(open_))


@F.pandas_udf(T.StringType())
def _closed(text: pd.Series) -> pd.Series:
    return text.map(closed)


_RESPONSE = "riskSummary string, explanationText string, suspiciousPatterns array<string>, recommendedActions array<string>, confidenceScore double, _bad string"


def parse_responses(rows: DataFrame) -> DataFrame:
    """id, outcome, risk_summary, explanation_text, suspicious_patterns, recommended_actions, confidence_score of rows (id, raw).

    outcome: parsed (valid JSON); repaired (cut off, its brackets closed); partial (fields found by pattern); error (the raw text,
    cut to 500 characters). Blank and null responses are errors.
    """
    read = lambda c: F.from_json(c, _RESPONSE, {"columnNameOfCorruptRecord": "_bad"})
    good = lambda c: F.col(c).isNotNull() & F.col(f"{c}._bad").isNull()
    field = lambda name: F.nullif(F.replace(F.regexp_extract("clean", TEXT_FIELD.format(name=name), 1), F.lit('\\"'), F.lit('"')), F.lit(""))
    seen = rows.select("id", "raw", unfenced(F.coalesce("raw", F.lit(""))).alias("clean")).withColumn("whole", read(F.col("clean")))
    seen = seen.withColumn("end", F.when(~good("whole") | (F.col("clean") == ""), _closed("clean"))).withColumn("mended", read(F.col("end")))
    seen = seen.withColumn("summary", field("riskSummary")).withColumn("told", field("explanationText"))
    cut = F.col("end").isNotNull()
    outcome = (
        F.when(F.col("clean") == "", "error").when(good("whole"), "parsed").when(cut & good("mended"), "repaired")
        .when(cut & F.coalesce("summary", "told").isNotNull(), "partial").otherwise("error")
    )
    seen = seen.withColumn("outcome", outcome)

    def pick(name: str, partial: Column, error: Column) -> Column:
        of = F.col("outcome")
        return F.when(of == "parsed", F.col(f"whole.{name}")).when(of == "repaired", F.col(f"mended.{name}")).when(of == "partial", partial).otherwise(error)

    none, number = F.array().cast("array<string>"), F.expr("try_cast(nullif(conf, '') AS double)")
    seen = seen.withColumn("conf", F.regexp_extract("clean", CONFIDENCE, 1))
    return seen.select(
        "id", "outcome",
        pick("riskSummary", F.coalesce("summary", F.lit(INCOMPLETE_SUMMARY)), F.lit(None).cast("string")).alias("risk_summary"),
        pick("explanationText", F.coalesce("told", "raw"), F.substring(F.coalesce("raw", F.lit("")), 1, 500)).alias("explanation_text"),
        pick("suspiciousPatterns", none, none).alias("suspicious_patterns"),
        pick("recommendedActions", F.array(F.lit(INCOMPLETE_ACTION)), none).alias("recommended_actions"),
        pick("confidenceScore", F.coalesce(number, F.lit(0.0)), F.lit(0.0)).alias("confidence_score"),
    )


def parse_scores(rows: DataFrame) -> DataFrame:
    """id, score of judge answers (id, raw): the number under "score", null unless it lies between 1 and 5."""
    found = rows.select("id", F.get_json_object(unfenced(F.col("raw")), "$.score").alias("s")).withColumn("score", F.expr("try_cast(s AS double)"))
    return found.select("id", F.when(F.col("score").between(1.0, 5.0), F.col("score")).alias("score"))
