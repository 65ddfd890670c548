"""Lines, comments and entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What ends a line, and what a comment line starts with.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
COMMENT_STARTS = ("#", "//", "/*", "*", "<!--")
#: Fixed values of the entropy scan.
CANDIDATE = r"""["']([A-Za-z0-9+/=_-]{20,})["']"""
SECRET_WORD = r"(?i)(key|secret|token|password|credential|api|auth|jwt|hmac|seed|salt|nonce|private)"
HARMLESS = r"(?i)(example|placeholder|your-secret|<your|xxx)"
HARMLESS_STARTS = ("sha256:", "sha512:", "base64:", "data:", "http://", "https://", "$argon2", "$2b$", "$scrypt$", "sha256sum", "md5sum")
HARMLESS_TEXTS = ("aaaaaaaaaaaaaaaa", "0000000000000000", "1111111111111111", "################################", "================", "00000000-0000-0000-0000-000000000000")
HEX_BITS, OTHER_BITS = 3.7, 5.0


def lines(files: DataFrame, content: str = "content", *, whole: Column | None = None) -> DataFrame:
    """One row per line, numbered from 1; a last line break opens no further line, null and empty contents have none.

    Files for which ``whole`` holds also give their whole content, as line 0: so one pass serves rules on lines and on files.
    """
    parts = F.split(content, LINE_BREAK, -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    if whole is not None:
        all_ = F.concat(F.array(F.when(whole, F.col(content))), F.coalesce(parts, F.array().cast("array<string>")))
        return files.select(*[c for c in files.columns if c != content], F.posexplode(all_).alias("line", "code")).where("code is not null")
    return files.select(*[c for c in files.columns if c != content], F.posexplode(parts).alias("line", "code")).withColumn("line", F.col("line") + 1)


def is_comment(code: Column, starts: tuple[str, ...] = COMMENT_STARTS) -> Column:
    """R2: the trimmed line starts like a comment."""
    text, out = F.regexp_replace(code, r"^\s+", ""), F.lit(False)
    for s in starts:
        out = out | F.startswith(text, F.lit(s))
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a text's characters."""

    def bits(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        shares = F.transform(F.array_distinct(chars), lambda c: (n - F.size(F.array_remove(chars, c))) / n)
        return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))

    # The characters are a lambda's variable: as an expression, the text would be split again for each of them.
    return F.when(F.length(text) > 0, F.element_at(F.transform(F.array(F.split(text, "")), bits), 1)).otherwise(0.0)


def entropy_secrets(line_rows: DataFrame) -> DataFrame:
    """Quoted strings of high entropy after a word that names a secret; the first of each line, with its confidence."""
    rows = line_rows.where(F.rlike("code", F.lit(CANDIDATE)) & ~is_comment(F.col("code")) & ~F.rlike("code", F.lit(HARMLESS)))
    found = F.regexp_extract_all("code", F.lit(CANDIDATE), F.lit(1))
    rows = rows.select("*", F.posexplode(found).alias("nth", "candidate"))
    rows = rows.withColumn("before", F.expr("substring_index(code, candidate, 1)")).where(F.rlike("before", F.lit(SECRET_WORD)))
    rows = rows.where(~F.lower("candidate").isin(*HARMLESS_TEXTS))
    for start in HARMLESS_STARTS:
        rows = rows.where(~F.startswith("candidate", F.lit(start)))
    rows = rows.where(F.length("candidate") - F.length(F.replace("candidate", F.lit("/"), F.lit(""))) <= 2)
    floor = F.when(F.rlike("candidate", F.lit("^[0-9a-fA-F]+$")), HEX_BITS).otherwise(OTHER_BITS)
    rows = rows.withColumn("bits", entropy(F.col("candidate"))).where(F.col("bits") >= floor)
    rows = rows.withColumn("confidence", F.round(F.least(F.lit(0.92), (F.col("bits") - floor) / (6.5 - floor) * 0.85 + 0.40), 2))
    keys = [c for c in line_rows.columns if c != "code"]
    return rows.groupBy(*keys).agg(F.min(F.struct("nth", "candidate", "confidence")).alias("m")).select(*keys, F.col("m.candidate").alias("candidate"), F.col("m.confidence").alias("confidence"))
