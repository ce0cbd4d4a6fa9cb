"""Text column functions: statement splitting, first line, attribute text, secrets.

All of them are Spark built-ins composed per row (regular expressions run in the
JVM); none needs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters a Java ``String.trim()`` removes, minus the line feed (lines never hold one).
_WS = "[\\x00-\\x09\\x0B-\\x20]"
_SLASH_LINE = f"{_WS}*{S.STATEMENT_TERMINATOR}{_WS}*(?=\\n|\\z)"
# One statement: skip empty lines, take a first non-empty line (a "/" line there is
# text, because the buffer is still empty), then every following line that is not
# a "/" line, then the "/" line that ends it. \G chains the matches, so the scan
# is linear and text after the last terminator is never matched.
_STATEMENT = f"\\G\\n+([^\\n]+(?:\\n(?!{_SLASH_LINE})[^\\n]*)*+)\\n{_SLASH_LINE}"


def normalize_newlines(text: str | Column) -> Column:
    """CR LF and lone CR become LF, as a line reader sees them."""
    return F.regexp_replace(_c(text), "\\r\\n?", "\n")


def _drop_final_terminator(text: Column) -> Column:
    # A line reader yields no empty line after a final terminator.
    return F.regexp_replace(text, "\\n\\z", "")


def split_statements(text: str | Column) -> Column:
    """Array of statements of an audit script split on "/" lines.

    Rules (each checked by a test):
    * a line whose Java-trimmed text is "/" ends the statement only when the
      buffer is not empty; otherwise it becomes text of the next statement;
    * empty lines at the start of a statement vanish;
    * text after the last terminator is dropped, unless no statement was found,
      when the whole buffer is the only statement (an empty script gives "").
    Lines inside a statement are joined by LF.
    """
    def split(body: Column) -> Column:
        def pick(found: Column) -> Column:
            return F.when(F.size(found) > 0, found).otherwise(F.array(F.regexp_replace(body, "^\\n+", "")))
        return _let(F.regexp_extract_all(F.concat(F.lit("\n"), body), F.lit(_STATEMENT), 1), pick)

    return _let(_drop_final_terminator(normalize_newlines(text)), split)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element ``transform``).

    A generator such as ``posexplode`` does not share repeated subexpressions, so
    the regular expressions above would otherwise run twice per text.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_line(text: str | Column) -> Column:
    """First line as a line reader returns it; NULL for an empty text."""
    t = normalize_newlines(text)
    return F.when((t.isNull()) | (t == ""), F.lit(None).cast("string")) \
        .otherwise(F.substring_index(t, "\n", 1))


def ruby_hash_to_json(text: str | Column) -> Column:
    """Ruby-hash attribute text to JSON text (``=>`` becomes ``:``, ``:nil`` becomes ``:null``)."""
    out = _c(text)
    for old, new in S.RUBY_HASH_REWRITES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def drive_of(path: str | Column, default: str = "C:") -> Column:
    """Drive of a Windows home path: text up to and including the first ":".

    A path without ":" gives an empty string; a NULL or empty path gives ``default``.
    """
    p = _c(path)
    return (F.when(p.isNull() | (p == ""), F.lit(default))
            .when(F.instr(p, ":") == 0, F.lit(""))
            .otherwise(F.concat(F.substring_index(p, ":", 1), F.lit(":"))))


def mask_password_arg(command_text: str | Column, password: str | Column) -> Column:
    """Replace the literal ``-P '<password>'`` argument by ``-P ***`` (no regex on the password)."""
    needle = fill(S.PASSWORD_ARG, password=_c(password))
    return F.when(_c(password).isNull(), _c(command_text)) \
        .otherwise(F.replace(_c(command_text), needle, F.lit(S.PASSWORD_MASK)))


def fill(template: str, null_text: str = "null", **values: Column) -> Column:
    """A fixed text with ``{name}`` placeholders filled from columns.

    A NULL value prints as ``null_text``: "null" as string interpolation in the
    agent does, "" as Oracle's ``||`` does.
    """
    import re

    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(values[m.group(1)].cast("string"), F.lit(null_text)))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def holds_text(value: Column, dtype: T.DataType, word: str) -> Column:
    """Whether any text inside a nested value contains ``word``; what ``to_json(value).contains(word)`` says for letters
    that no field name holds, without writing the value out. Never NULL."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(value.contains(word), F.lit(False))
    if isinstance(dtype, T.StructType):
        found = F.lit(False)
        for f in dtype.fields:
            found = found | holds_text(value.getField(f.name), f.dataType, word)
        return found
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: holds_text(x, dtype.elementType, word)), F.lit(False))
    if isinstance(dtype, T.MapType):
        return holds_text(F.map_keys(value), T.ArrayType(dtype.keyType), word) | holds_text(F.map_values(value), T.ArrayType(dtype.valueType), word)
    return F.lit(False)
