"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate words in the index, in ranking, and in identifiers.
INDEX_DELIMITERS = " _./\\()[]{};,:\"'\t\n\r<>=+-*&|!?@#$%^~`"
RANK_DELIMITERS = INDEX_DELIMITERS.replace("\\", "")
IDENTIFIER_DELIMITERS = "".join(c for c in INDEX_DELIMITERS if c not in "._:\\")


def char_class(characters: str) -> str:
    """A regular expression for one of the characters."""
    named = {"\t": r"\t", "\n": r"\n", "\r": r"\r"}
    return "[" + "".join(named.get(c, "\\" + c if not c.isalnum() and c != " " else c) for c in characters) + "]"


def _parts(text: Column, delimiters: str) -> Column:
    """Distinct words by first place: repeated ones add no term, and are left out before words are looked at one by one."""
    return F.filter(F.array_distinct(F.split(F.coalesce(text, F.lit("")), char_class(delimiters))), lambda p: p != "")


def camel_all(word: Column) -> Column:
    """Pieces that begin at every upper-case letter."""
    return F.split(word, r"(?=\p{Lu})")


def camel_boundary(word: Column) -> Column:
    """Pieces that begin where lower case turns to upper case: lower-cased, of two characters or more."""
    return F.filter(F.transform(F.split(word, r"(?<=\p{Ll})(?=\p{Lu})"), F.lower), lambda p: F.length(p) >= 2)


def tokenize(text: Column) -> Column:
    """Distinct lower-case terms: the camel pieces of each word, then the word, of two characters or more."""
    # only words with a capital after their first character have pieces besides themselves
    pieces = F.flatten(F.transform(_parts(text, INDEX_DELIMITERS), lambda p: F.when(p.rlike(r"(?s).\p{Lu}"), F.concat(camel_all(p), F.array(p))).otherwise(F.array(p))))
    return F.array_distinct(F.transform(F.filter(pieces, lambda p: F.length(p) >= 2), F.lower))


def ranker_terms(text: Column) -> Column:
    """Distinct lower-case words of two characters or more, without camel pieces."""
    return F.array_distinct(F.filter(F.transform(_parts(text, RANK_DELIMITERS), F.lower), lambda p: F.length(p) >= 2))


def identifier_parts(text: Column) -> Column:
    """Of dotted identifiers: their segments of two characters or more, then the whole."""
    words = F.filter(_parts(text, IDENTIFIER_DELIMITERS), lambda w: w.contains(".") & (F.length(w) >= 3))
    long = lambda w: F.filter(F.split(w, r"\."), lambda s: F.length(s) >= 2)
    sound = F.filter(words, lambda w: F.size(long(w)) >= 1)
    return F.array_distinct(F.transform(F.flatten(F.transform(sound, lambda w: F.concat(long(w), F.array(w)))), F.lower))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]*$", "")


def semantic_id(file: Column, namespace: Column, cls: Column, member: Column, kind: Column, index: Column, signature: Column) -> Column:
    parts = [file, namespace, cls, member, kind, index.cast("string"), F.coalesce(signature, F.lit(""))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def content_hash(content: Column) -> Column:
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, F.lit("")).otherwise(F.sha2(content, 256))


def build_content(*parts: Column) -> Column:
    """Non-blank parts, trimmed, a blank line between."""
    trimmed = F.transform(F.array(*parts), lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), r"^\s+|\s+$", ""))
    return F.array_join(F.filter(trimmed, lambda p: p != ""), "\n\n")


def boost_content(content: Column, cls: Column, member: Column, controller: Column, service: Column, middleware: Column) -> Column:
    """content with marker lines that repeat names and framework words."""
    lines = [F.concat(F.lit("[CLASS_BOOST] "), cls, F.lit(" "), cls), F.concat(F.lit("[MEMBER_BOOST] "), member, F.lit(" "), member, F.lit(" "), member)]
    words = ((controller, "controller api http"), (service, "service business logic"), (middleware, "middleware pipeline"))
    marks = [F.when(flag, F.lit(f"[FRAMEWORK] {text}")) for flag, text in words]
    return F.concat(content, F.concat_ws("\n", *lines, *marks), F.lit("\n"))


def preview(text: Column, limit: int, documentation: bool = False) -> Column:
    """One line, cut at limit characters; documentation loses its slashes."""
    one = F.regexp_replace(F.regexp_replace(text, "\n", " "), "\r", "")
    one = F.trim(F.replace(one, F.lit("///"), F.lit(""))) if documentation else one
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("..."))).otherwise(one)


def needs_split(text: Column, max_lines: int) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"^\s*$") & (F.size(F.split(F.coalesce(text, F.lit("")), "\n")) > max_lines)


def line_windows(text: Column, max_lines: int, overlap: int) -> Column:
    """array<struct<index, start_line, end_line, content>>: windows that share overlap lines, the last ending with the text."""
    if not 0 <= overlap < max_lines:
        raise ValueError("overlap must be at least 0 and less than max_lines")
    lines, step = F.split(F.coalesce(text, F.lit("")), r"\r?\n"), max_lines - overlap
    count = F.greatest(F.lit(1), F.ceil((F.size(lines) - overlap) / F.lit(step)).cast("int"))

    def window(i: Column) -> Column:
        start = i * step
        return F.struct(i.alias("index"), (start + 1).alias("start_line"), F.least(start + max_lines, F.size(lines)).alias("end_line"), F.array_join(F.slice(lines, start + 1, F.lit(max_lines)), "\n").alias("content"))

    return F.transform(F.sequence(F.lit(0), count - 1), window)
