"""Column functions over texts of change requests and of language models' answers; lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x0B\p{Z}\x{FEFF}]"
METADATA = r"^(index |--- |\+\+\+ |@@ )"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def normalized_diff(diff: Column) -> Column:
    """Contents of a diff's files in the byte order of their new paths, without metadata lines and blank lines.

    A null or empty diff is empty; files of one path keep their order."""
    parts = F.filter(F.split(F.coalesce(diff, F.lit("")), "(?m)^diff --git "), lambda p: stripped(p) != "")

    def file(part: Column, at: Column) -> Column:
        first = F.substring_index(part, "\n", 1)
        path = F.regexp_extract(first, r"\sb/(.+)$", 1)
        lines = F.filter(F.slice(F.split(part, "\n"), F.lit(2), F.greatest(F.size(F.split(part, "\n")), F.lit(1))), lambda x: ~x.rlike(METADATA))
        lines = F.filter(F.transform(lines, stripped), lambda x: x != "")
        return F.struct(F.when(path == "", stripped(first)).otherwise(path).alias("path"), at.alias("at"), F.array_join(lines, "\n").alias("content"))

    return F.array_join(F.transform(F.array_sort(F.transform(parts, file)), lambda f: f["content"]), "\n")


def diff_hash(diff: Column) -> Column:
    return F.sha2(normalized_diff(diff), 256)


def tokens(text: Column, chars_per_token: float = 3.5) -> Column:
    return F.ceil(F.length(text) / F.lit(float(chars_per_token)))


def within_budget(items: Column, budget: Column, chars_per_token: float = 4.0) -> Column:
    """The longest head of items, joined by newlines, within the budget; a newline costs a token."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("over"))

    def add(s: Column, x: Column) -> Column:
        used = s["used"] + tokens(F.coalesce(x, F.lit("")), chars_per_token) + F.when(s["kept"] > 0, 1).otherwise(0)
        over = s["over"] | (used > budget)
        return F.struct(F.when(over, s["used"]).otherwise(used).alias("used"), F.when(over, s["kept"]).otherwise(s["kept"] + 1).alias("kept"), over.alias("over"))

    kept = F.aggregate(items, start, add, lambda s: s["kept"])
    return F.array_join(F.transform(F.slice(items, F.lit(1), kept), lambda x: F.coalesce(x, F.lit(""))), "\n")


def code_input(paths: Column, budget: Column, fallback: Column, chars_per_token: float = 4.0) -> Column:
    joined = within_budget(paths, budget, chars_per_token)
    return F.coalesce(F.when(joined != "", joined), F.when(fallback != "", fallback), F.lit("(no files)"))


def intent_input(title: Column, body: Column, paths: Column, budget: int, chars_per_token: float = 4.0) -> Column:
    """Title and body, cut in proportion where they alone pass the budget, else followed by the paths that fit."""
    header = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    n = tokens(header, chars_per_token)
    tail = within_budget(paths, F.lit(budget) - n - 1, chars_per_token)
    cut = F.substring(header, F.lit(1), F.floor(F.lit(float(budget)) / n * F.length(header)).cast("int"))
    return F.when(n >= budget, cut).when(tail != "", F.concat(header, F.lit("\n"), tail)).otherwise(header)


def code_text(title: Column, paths: Column) -> Column:
    return F.when(F.size(paths) > 0, F.concat(title, F.lit("\n"), F.array_join(paths, "\n"))).otherwise(title)


def embeddable(text: Column, most_tokens: int = 8191, chars_per_token: float = 4.0) -> Column:
    """The text an embedding model gets: a space for none, cut at the model's limit."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, " ").otherwise(F.substring(text, 1, int(most_tokens * chars_per_token)))


def summary(number: Column, title: Column, author: Column, files: Column, body: Column, body_chars: int = 0, n_files: int = 0) -> Column:
    """One record as lines of a prompt; 0 sets no limit."""
    listed, shown = F.array_join(files, ", "), F.coalesce(body, F.lit("(none)"))
    if n_files:
        more = F.concat(F.array_join(F.slice(files, 1, n_files), ", "), F.lit(", ... (+"), (F.size(files) - n_files).cast("string"), F.lit(" more)"))
        listed = F.when(F.size(files) > n_files, more).otherwise(listed)
    if body_chars:
        shown = F.when(F.length(shown) > body_chars, F.concat(F.substring(shown, 1, body_chars), F.lit("..."))).otherwise(shown)
    return F.concat(F.lit("#"), number.cast("string"), F.lit(" "), title, F.lit(" by "), author, F.lit("\nFiles: "), listed, F.lit("\nBody: "), shown)


def without_fence(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(answer, r"(?i)^```(?:json)?\s*\n?", ""), r"\n?```\s*$", "")


def verdict(answer: Column) -> Column:
    """is_duplicate, confidence, relationship, rationale of a model's JSON answer.

    Missing, null, false, 0 and "" are false, all else (the string "false" too) is true. What is no number is confidence 0.
    An answer that is no JSON, or is null, has the relationship parse_error."""
    raw = without_fence(answer)
    known = F.coalesce(F.try_parse_json(raw).isNotNull() & (F.trim(raw) != "null"), F.lit(False))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(F.try_parse_json(raw), f"$.{name}", kind)

    flag, number = field("isDuplicate", "string"), field("confidence", "double")
    text = F.schema_of_variant(field("isDuplicate", "variant")) == "STRING"
    true = F.when(F.coalesce(text, F.lit(False)), flag != "").otherwise(~F.coalesce(flag, F.lit("false")).isin("false", "0", "null"))
    return F.struct(
        (known & true).alias("is_duplicate"),
        F.when(known, F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(known, F.coalesce(field("relationship", "string"), F.lit("unknown"))).otherwise("parse_error").alias("relationship"),
        F.when(known, F.coalesce(field("rationale", "string"), F.lit(""))).otherwise("no JSON").alias("rationale"),
    )


def point_uuid(name: Column) -> Column:
    """The id of a stored vector: the MD5 of its name with four dashes."""
    return F.regexp_replace(F.md5(name), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def summary_of(answer: Column) -> Column:
    return F.coalesce(F.get_json_object(answer, "$.summary"), answer)


def display_label(label: Column, most: int = 80) -> Column:
    """At most `most` characters, cut at the last space if that is beyond the 40th, then three dots."""
    head = F.substring(label, 1, most)
    at = F.length(F.regexp_extract(head, "(?s)^(.*) ", 1))
    return F.when(F.length(label) > most, F.concat(F.when(at > 40, F.substring(head, F.lit(1), at)).otherwise(head), F.lit("..."))).otherwise(F.coalesce(label, F.lit("")))


def slug(c: Column) -> Column:
    """owner, name of owner/name; null for any other form."""
    p = F.split(c, "/")
    return F.when((F.size(p) == 2) & (p[0] != "") & (p[1] != ""), F.struct(p[0].alias("owner"), p[1].alias("name")))


def request_number(c: Column) -> Column:
    """Number after /pull/, else the leading number; null without one."""
    return F.coalesce(F.regexp_extract(c, r"/pull/(\d+)", 1).try_cast("long"), F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long"))


def age(at: Column, now: Column) -> Column:
    hours = F.floor((F.unix_micros(now) - F.unix_micros(at)) / F.lit(3600 * 1000000))
    return F.when(hours < 1, "just now").when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))


def dollars(c: Column) -> Column:
    return F.when(c < 0.01, "<$0.01").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", c)))
