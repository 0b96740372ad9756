"""Column functions on text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import fixed_values as fixed

# With (?U) \s covers every Unicode space; the four separator controls are not in it.
_SPACE = r"[\s\x1c-\x1f]"
# The same set of characters one by one, for trimming without a regular expression.
WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def null_tokens(c: Column, tokens: Iterable[str]) -> Column:
    """Null for exactly the given texts, unchanged otherwise."""
    return F.when(~c.isin(*tokens), c)


def vocabulary(c: Column, allowed: Iterable[str]) -> Column:
    """The value if it is in the vocabulary, else null."""
    return F.when(c.isin(*allowed), c)


def free_text(c: Column) -> Column:
    """Strip, turn null tokens into null, cut to the text limit."""
    return F.substring(null_tokens(strip(c), fixed.TEXT_NULL_TOKENS), 1, fixed.TEXT_LIMIT)


def word_count(c: Column) -> Column:
    words = F.split(c, rf"(?U){_SPACE}+")
    return F.size(F.filter(words, lambda w: w != ""))


def redact(c: Column, secrets: Sequence[str]) -> Column:
    """Replace each secret of useful length by the redaction mark."""
    for secret in secrets:
        if secret and len(secret) >= fixed.SECRET_MIN_LENGTH:
            c = F.replace(c, F.lit(secret), F.lit(fixed.REDACTION_MARK))
    return c


def _starts(patterns: Sequence[str]) -> str:
    """A lookahead for the first characters of the patterns, if each starts with a plain one.

    It turns away most positions of a text with one test instead of one per pattern.
    """
    first = [p.removeprefix("\\")[0] for p in patterns]
    plain = all(p[0] not in "\\[(.^$*+?{|" or p.startswith("\\[") for p in patterns)
    return "(?=[" + "".join("\\" + c if not c.isalnum() else c for c in dict.fromkeys(first)) + "])" if plain else ""


def first_injection(c: Column, patterns: Sequence[str] = fixed.INJECTION_PATTERNS) -> Column:
    """The first pattern, in order, that occurs anywhere in the text; null if none does.

    ``when`` branches are evaluated in order and only as far as needed, and a single
    combined expression in front keeps clean text, the usual case, at one regex pass.
    """
    spoken = ["(?:" + p.replace(r"\s", _SPACE) + ")" for p in patterns]
    suspicious = c.rlike("(?iU)" + _starts(patterns) + "(?:" + "|".join(spoken) + ")")
    which = F.coalesce(*[F.when(c.rlike("(?iU)" + regex), F.lit(p)) for regex, p in zip(spoken, patterns)])
    return F.when(suspicious, which)


def first_injection_of(fields: Sequence[tuple[str, Column]]) -> Column:
    """struct<source, pattern> of the first field with a hit, in field order."""
    hits = []
    for name, c in fields:
        pattern = first_injection(c)
        hits.append(F.when(pattern.isNotNull(), F.struct(F.lit(name).alias("source"), pattern.alias("pattern"))))
    return F.coalesce(*hits)


def fill_template(template: str, **parts: Column | str) -> Column:
    """A text template with ``{name}`` slots as one ``concat``."""
    pieces: list[Column] = []
    rest = template
    while rest:
        at = rest.find("{")
        if at < 0:
            pieces.append(F.lit(rest))
            break
        end = rest.index("}", at)
        if at:
            pieces.append(F.lit(rest[:at]))
        part = parts[rest[at + 1:end]]
        pieces.append(F.lit(part) if isinstance(part, str) else part)
        rest = rest[end + 1:]
    return F.concat(*pieces)


def title_bool(c: Column) -> Column:
    """``True`` / ``False`` as text."""
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def quoted_list(c: Column) -> Column:
    """An array of texts as ``['a', 'b']``."""
    inner = F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return F.concat(F.lit("["), inner, F.lit("]"))
