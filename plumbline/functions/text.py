"""Text cleaning, hits, message building and prompt templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Credential shapes to look for.
SECRET_PATTERNS = {
    "model_hub_token": r"\bhf_[A-Za-z0-9]{20,}\b",
    "api_key": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b",
    "code_host_token": r"\b(?:ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b",
    "cloud_access_key": r"\bAKIA[A-Z0-9]{16}\b",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}


def count_symbol(col: Column, symbol: str) -> Column:
    return ((F.length(col) - F.length(F.replace(col, F.lit(symbol), F.lit("")))) / len(symbol)).cast("int")


def clean_text(col: Column, pattern: str, replacement: str = "") -> Column:
    return F.trim(F.regexp_replace(col, pattern, replacement))


def extract_hits(df: DataFrame, col: str, pattern: str, keep: Sequence[str], group: int = 1,
                 name: str = "hit") -> DataFrame:
    """One row per regex match in the whole text."""
    return df.select(*keep, F.explode(F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(group))).alias(name))


def secret_scan(df: DataFrame, text: str, keep: Sequence[str],
                patterns: Mapping[str, str] = SECRET_PATTERNS) -> DataFrame:
    """(keep…, category) for every pattern the text contains; text itself is never emitted."""
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()]))
    return df.select(*keep, text).select(*keep, F.explode(found).alias("category"))


def resolve_identity(hits: DataFrame, key: str, name: str) -> DataFrame:
    """One distinct normalised name per key = resolved, several = conflict, none = unresolved.

    Only min, max and a distinct count are kept per key, so a key with many hits
    costs no more than one with few.
    """
    clean = F.nullif(F.lower(F.trim(F.col(name))), F.lit(""))
    stats = hits.select(key, clean.alias("_n")).groupBy(key).agg(
        F.countDistinct("_n").alias("n_names"), F.min("_n").alias("_first"))
    status = (F.when(F.col("n_names") == 1, "resolved").when(F.col("n_names") > 1, "conflict").otherwise("unresolved"))
    return stats.select(key, "n_names", status.alias("status"),
                        F.when(F.col("n_names") == 1, F.col("_first")).alias("resolved_name"))


def to_messages(turns: str, system: Column | None = None) -> Column:
    """Array of turns -> array of (role, content): even = user, odd = assistant, optional system first."""
    chat = F.transform(F.col(turns), lambda x, i: F.struct(
        F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), x.alias("content")))
    if system is None:
        return chat
    head = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.when(system.isNotNull(), F.concat(head, chat)).otherwise(chat)


def turn_role(turn: Column) -> Column:
    """Role of a turn kept as a row: even = user, odd = assistant."""
    return F.when(turn % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))


def join_parts(parts: str, sep: str = "\n") -> Column:
    return F.array_join(F.col(parts), sep)


def fim_prompt(prefix: Column, suffix: Column) -> Column:
    """Fill-in-the-middle prompt: prefix, suffix and middle markers around the two parts."""
    # The marker words of the template.
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    return F.concat(F.lit(marks[0]), prefix, F.lit(marks[1]), suffix, F.lit(marks[2]))


def choice_prompt(question: Column, wrong: Sequence[Column], right: Column, seed: object, key: Column) -> tuple[Column, Column]:
    """Multiple-choice text with choices in md5 order, and the lettered answer; there are letters for four choices, more are refused."""
    order = lambda c: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), c)).alias("h"), c.alias("c"))
    # Letters and wording of the template.
    letters, opening = "ABCD", "What is the correct answer to the following question: "
    if len(wrong) + 1 > len(letters):
        raise ValueError(f"at most {len(letters)} choices")
    shuffled = F.array_sort(F.array(*[order(F.trim(c)) for c in (*wrong, right)]))
    lines = F.transform(shuffled, lambda x, i: F.concat(
        F.lit("\n("), F.substring(F.lit(letters), i + 1, F.lit(1)), F.lit(") "), x["c"]))
    prompt = F.concat(F.lit(opening), question, F.lit("\n\nChoices:"), F.array_join(lines, ""))
    place = F.array_position(F.transform(shuffled, lambda x: x["c"]), F.trim(right)).cast("int")
    answer = F.concat(F.lit("("), F.substring(F.lit(letters), place, F.lit(1)), F.lit(") "), F.trim(right))
    return prompt, answer


def distinct_inputs(df: DataFrame, prompt: Column, by: Sequence[str] = ()) -> DataFrame:
    """Number of requests and of distinct canonical prompts (by hash, so long texts never shuffle)."""
    return df.groupBy(*by).agg(F.count("*").alias("n_requests"),
                               F.countDistinct(F.sha2(prompt, 256)).alias("n_distinct"))
