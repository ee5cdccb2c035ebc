"""Column expressions for transcript text: truncation, white space, tags, redaction, handles, paths, time.

All are built from Spark SQL functions; those on whole strings stay inside code generation, lambda functions
(redaction, commits) are interpreted. Patterns that face user prose are
Unicode-aware ((?U)), since Java's classes are ASCII by default. `s` is a column name or a column.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- truncation ----------------------------------------------------------------------------------


def _c(s: str | Column) -> Column:
    return F.col(s) if isinstance(s, str) else s


def truncate_bytes(s: str | Column, n: int) -> Column:
    """At most n UTF-8 bytes, cut between characters, with '...' if something went."""
    raw = F.encode(_c(s), "UTF-8")
    cut = F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, n - i).cast("string")) for i in range(min(n, 4))), F.lit(""))
    return F.when(F.octet_length(_c(s)) <= n, _c(s)).otherwise(F.concat(cut, F.lit("...")))


def head_chars(s: str | Column, n: int) -> Column:
    """struct(text, truncated_chars): the first n characters and how many went."""
    return F.struct(F.substring(_c(s), 1, n).alias("text"), F.greatest(F.length(_c(s)) - n, F.lit(0)).cast("bigint").alias("truncated_chars"))


def truncate_chars(s: str | Column, n: int) -> Column:
    return F.when(F.length(_c(s)) > n, F.concat(F.substring(_c(s), 1, n), F.lit("…"))).otherwise(_c(s))


def truncate_tail(s: str | Column, n: int) -> Column:
    """The last n characters behind a note of how many went."""
    cut = F.length(_c(s)) - n
    return F.when(cut > 0, F.concat(F.lit("[truncated "), cut.cast("string"), F.lit(" chars]…"), F.substring(_c(s), cut + 1, F.lit(n)))).otherwise(_c(s))


# -- white space ----------------------------------------------------------------------------------


def strip(s: str | Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_c(s), r"(?U)\A\s+|\s+\z", "")


def single_line(s: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(s), r"(?U)\s+", " "))


def paragraphs_on_one_line(s: str | Column) -> Column:
    """White-space runs as one space, runs with a line break as ' ⏎ '."""
    return F.regexp_replace(F.regexp_replace(strip(s), r"(?U)[\s&&[^\n]]*\n\s*", " ⏎ "), r"(?U)\s+", " ")


def collapse_blank_lines(s: str | Column) -> Column:
    """At most one blank line in a row; blanks around line breaks of a run go with it."""
    two = F.regexp_replace(_c(s), r"\n[ \t\r]*\n[ \t\r\n]*", "\n\n")
    return F.regexp_replace(two, r"\n[ \t\r]+", "\n")


def first_line(s: str | Column) -> Column:
    return F.regexp_replace(F.substring_index(_c(s), "\n", 1), "\r$", "")


# -- tags and wrappers -----------------------------------------------------------------------------


def strip_reminders(s: str | Column) -> Column:
    """Without complete <system-reminder> blocks; an unterminated one stays."""
    return F.regexp_replace(_c(s), r"(?s)<system-reminder>.*?</system-reminder>", "")


def unwrap_pasted(s: str | Column) -> Column:
    return F.replace(F.regexp_replace(_c(s), r"(?s)<pasted_content[^>]*>", "[pasted] "), F.lit("</pasted_content>"), F.lit(""))


def tag(s: str | Column, name: str) -> Column:
    """The text of the first <name> element, or null."""
    pattern = rf"(?s)<{name}>(.*?)</{name}>"
    return F.when(_c(s).rlike(pattern), strip(F.regexp_extract(_c(s), pattern, 1)))


def attribute(s: str | Column, name: str) -> Column:
    pattern = rf'{name}="([^"]*)"'
    return F.when(_c(s).rlike(pattern), F.regexp_extract(_c(s), pattern, 1))


def match_key(s: str | Column, chars: int = 200) -> Column:
    """What two texts must share to count as the same queued message."""
    return F.substring(single_line(unwrap_pasted(strip_reminders(s))), 1, chars)


# -- redaction -------------------------------------------------------------------------------------

REDACTED = "[REDACTED]"
#: Blanks within a line: all Unicode white space but the line break.
_B = r"[\s&&[^\n]]"
#: The forms of credentials. All match within one line of a text of many; a key block from its first line to its last.
PEM = r"(?ims)^(?=[^\n]*-----begin )(?=[^\n]*private key-----)[^\n]*.*?(?:\n(?=[^\n]*-----end )(?=[^\n]*private key-----)[^\n]*|\z)"
CREDENTIAL = rf"""(?:^|[^A-Za-z0-9_\n])["']?(?:password|passwd|secret|token|api[_-]?key|authorization|[A-Za-z0-9_]+_(?:password|passwd|secret|token|api[_-]?key|authorization))["']?{_B}*[:=]"""
AUTH_HEADER = rf"""\b(?:bearer|basic){_B}+[^\s,;"']+"""
LINE = rf"(?imU)^[^\n]*?(?:{CREDENTIAL}|{AUTH_HEADER})[^\n]*"
JWT = r"(?U)\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"
API_TOKEN = r"(?U)\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[A-Z0-9]{16})\b"
USERINFO = r"(?U)([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]+:[^/@\s]+@"
#: Every form holds one of these (in lower case; the last two fold to s and k).
SIGNS = ("password", "passwd", "secret", "token", "api", "authorization", "bearer", "basic", "private key-----", "eyj", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "akia", "://", "\u017f", "\u212a")
_CONTROL = r"[\p{Cc}&&[^\t\n]]"


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _holds_sign(s: Column) -> Column:
    return _let(F.lower(s), lambda low: reduce(or_, (F.contains(low, F.lit(sign)) for sign in SIGNS)))


def _cut(s: Column, n: Column, pattern: str, by: str, then) -> Column:
    """Matches replaced and counted, and the next step on what is left."""
    return _let(F.struct(F.regexp_replace(s, pattern, by).alias("s"), (n + F.regexp_count(s, F.lit(pattern))).alias("n")), lambda x: then(x.s, x.n))


def redact(s: str | Column) -> Column:
    """struct(text, n): the text without credentials and how many redactions that took. A line that holds a named
    credential goes as a whole, a key block as one; leading empty lines and the last line break go too.

    Each form is searched once in the whole text, and only in texts that hold one of its SIGNS."""
    steps = ((LINE, REDACTED), (JWT, REDACTED), (API_TOKEN, REDACTED), (USERINFO, r"$1\[REDACTED\]@"))

    def cleaned(text: Column, n: Column, rest=steps) -> Column:
        return _cut(text, n, *rest[0], lambda t, m: cleaned(t, m, rest[1:])) if rest else F.struct(text.alias("text"), n.alias("n"))

    def whole(raw: Column) -> Column:
        lines = F.regexp_replace(raw, r"\r\n?", "\n")
        plain = lambda t: F.regexp_replace(F.regexp_replace(t, _CONTROL, ""), r"\A\n+|\n\z", "")
        zero = F.lit(0).cast("bigint")
        # A key block is known by its first line, with or without control characters in it.
        found = lambda t: _cut(t, zero, PEM, REDACTED, lambda u, n: cleaned(u, n))
        return _let(plain(lines), lambda t: F.when(_holds_sign(t), found(t)).otherwise(F.struct(t.alias("text"), zero.alias("n"))))

    return _let(_c(s), whole)


def has_credential(s: str | Column) -> Column:
    c = _c(s)
    return _holds_sign(c) & (c.rlike(LINE) | c.rlike(JWT) | c.rlike(API_TOKEN) | c.rlike(USERINFO))


def safe_scalar(s: str | Column, n: int) -> Column:
    return F.nullif(truncate_chars(strip(redact(s).text), n), F.lit(""))


# -- handles, ids, paths, time ---------------------------------------------------------------------


def handle(offset: str | Column) -> Column:
    return F.concat(F.lit("@o"), _c(offset).cast("string"))


def parse_handle(s: str | Column) -> Column:
    return F.nullif(F.regexp_extract(_c(s), r"^(?:@o)?([0-9]{1,19})$", 1), F.lit("")).try_cast("bigint")


def is_uuid(s: str | Column) -> Column:
    return _c(s).rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")


def is_commit_hash(s: str | Column) -> Column:
    return _c(s).rlike(r"\A[0-9a-fA-F]{7,64}\z")


def rollout_id(file_name: str | Column) -> Column:
    """The UUID in the last five dash groups of a rollout's file name."""
    found = F.regexp_extract(_c(file_name), r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$", 1)
    return F.nullif(found, F.lit(""))


def slashes(s: str | Column) -> Column:
    return F.replace(_c(s), F.lit("\\"), F.lit("/"))


def basename(s: str | Column) -> Column:
    return F.element_at(F.split(_c(s), r"[/\\]"), -1)


def file_stem(s: str | Column) -> Column:
    return F.regexp_replace(basename(s), r"(?<=.)\.[^.]*$", "")


def repository_label(url: str | Column) -> Column:
    bare = F.regexp_replace(F.regexp_extract(_c(url), r"^([^?#]*)", 1), r"[/\\]+$", "")
    return F.nullif(F.regexp_replace(F.element_at(F.split(bare, r"[/\\:]"), -1), r"(?:\.git)+$", ""), F.lit(""))


def safe_relative_path(path: str | Column, cwd: str | Column) -> Column:
    """path below cwd, relative and with slashes, or null if it leaves cwd or looks unsafe."""
    root = F.regexp_replace(_c(cwd), r"/+$", "")
    below = F.startswith(_c(path), F.concat(root, F.lit("/")))
    relative = slashes(F.substr(_c(path), F.length(root) + 2))
    safe = (relative != "") & ~relative.rlike(r"(?:^|/)\.\.?(?:/|$)|\p{Cc}|^/") & (F.octet_length(relative) <= 512) & ~has_credential(relative)
    return F.when(below & safe, relative)


def rfc3339(s: str | Column) -> Column:
    return F.when(_c(s).rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}"), F.try_to_timestamp(_c(s)))


def iso_utc(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis(ms: str | Column) -> Column:
    """Epoch milliseconds as a timestamp; zero and less mean absent."""
    return F.when(_c(ms) > 0, F.timestamp_millis(_c(ms)))


def first_non_empty(*columns: str | Column) -> Column:
    return F.coalesce(*(F.nullif(_c(c), F.lit("")) for c in columns))


# -- commits ---------------------------------------------------------------------------------------

COMMIT_LINE = r"(?m)^\[(.+?)\s+([0-9a-f]{7,40})\]\s+(.+)$"


def is_git_commit(command: str | Column) -> Column:
    return F.contains(_c(command), F.lit("git")) & _c(command).rlike(r"(?U)(?:^|\s)commit(?:\s|$)")


def repo_of_command(command: str | Column) -> Column:
    """The path after the first '-C ', quoted or bare."""
    rest = F.regexp_extract(_c(command), r"(?sU)-C \s*(.*)$", 1)
    quoted = F.regexp_extract(rest, r'^"([^"]*)"', 1)
    bare = F.regexp_extract(rest, r"(?U)^([^\s\"]\S*)", 1)
    return F.coalesce(F.when(rest.rlike(r'^"[^"]*"'), quoted), F.nullif(bare, F.lit("")))


def commit_lines(output: str | Column) -> Column:
    """array<struct<branch, hash, subject>> of the confirmation lines in a command's output."""
    part = lambda i: F.regexp_extract_all(_c(output), F.lit(COMMIT_LINE), F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("branch"), part(2).alias("hash"), part(3).alias("subject")), lambda x: x)


# -- search ----------------------------------------------------------------------------------------


def plain_literal(pattern: str) -> str | None:
    """The pattern in lower case, if it is nothing but ASCII word characters: then raw lines can be
    filtered by it before they are parsed."""
    return pattern.lower() if pattern and pattern.isascii() and pattern.replace("_", "a").isalnum() else None


def snippet(s: str | Column, pattern: str, around: int) -> Column:
    """The first match with `around` characters on either side, ellipses where text goes on."""
    p = F.lit(f"(?iu){pattern}")
    at = F.regexp_instr(_c(s), p)
    size = F.length(F.regexp_substr(_c(s), p))
    begin = F.greatest(at - around, F.lit(1))
    end = F.least(at + size - 1 + around, F.length(_c(s)))
    body = F.substring(_c(s), begin, end - begin + 1)
    return F.concat(F.when(begin > 1, F.lit("…")).otherwise(""), body, F.when(end < F.length(_c(s)), F.lit("…")).otherwise(""))
