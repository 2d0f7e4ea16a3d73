"""Columns over text: normal forms, patterns, snippets, hashes, identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")


def normalised(text: Column) -> Column:
    """Byte order mark off, line feeds only, no white space at the ends of lines, one line feed at the end."""
    lines = F.regexp_replace(unix_lines(F.regexp_replace(text, "^﻿", "")), r"[ \t]+(?=\n|$)", "")
    return F.concat(F.regexp_replace(lines, r"\n+\z", ""), F.lit("\n"))


def structural(text: Column) -> Column:
    """What a fingerprint of any format is taken of: line ends trimmed, blank lines at either end off, several between lines as one."""
    lines = F.regexp_replace(unix_lines(text), r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(lines, r"^\s+|\s+\z", ""), r"\n{3,}", "\n\n")


def fingerprint(text: Column) -> Column:
    return F.md5(structural(text))


#: A quoted string (kept as it is), or white space.
_STRING_OR_GAP = r'("(?:[^"\\]|\\.)*")|\s+'
#: A quoted string (kept), or a comment to the end of its line or between marks.
_STRING_OR_COMMENT = r'("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/'


def structural_of(text: Column, extension: Column) -> Column:
    """What a fingerprint is taken of, by a file's extension: JSON without white space between tokens, XML without declaration and white space between tags, code without comments and with single spaces, else structural()."""
    bare = F.lower(F.ltrim(extension, F.lit(".")))
    json = F.regexp_replace(text, _STRING_OR_GAP, "$1")
    bared = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    xml = F.regexp_replace(F.regexp_replace(bared(text), r"^<\?xml[^>]*\?>\s*", ""), r">\s+<", "><")
    # A mark stands for each comment, and behind each string, where it goes again
    marked = F.replace(F.regexp_replace(text, _STRING_OR_COMMENT, "$1\x01"), F.lit('"\x01'), F.lit('"'))
    code = bared(F.regexp_replace(marked, r"[\x01\s]+", " "))
    return F.when(bare == "json", json).when(bare.isin("xml", "csproj", "config"), xml).when(bare.isin("cs", "java", "js", "ts", "go", "c", "cpp"), code).otherwise(structural(text))


def snippet_features(text: Column) -> Column:
    """struct of what can be read off a snippet of code without a compiler, comments and strings aside: lines, branches, loops, cyclomatic, parameters, calls and types (sorted sets of names)."""
    bare = F.regexp_replace(text, _STRING_OR_COMMENT, " ")
    count = lambda rx: F.regexp_count(bare, F.lit(rx))
    names = lambda rx: F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(rx), 1)))
    branches, loops = count(r"\b(?:if|case|catch)\b"), count(r"\b(?:for|foreach|while)\b")
    called = F.filter(names(r"([A-Za-z_]\w*)\s*\("), lambda n: ~n.isin("if", "for", "foreach", "while", "switch", "catch", "return", "using", "lock"))
    head = F.regexp_extract(bare, r"\(([^()]*)\)", 1)
    return F.struct(
        F.size(F.split(text, "\n")).alias("lines"), branches.alias("branches"), loops.alias("loops"), (1 + branches + loops + count(r"&&|\|\|")).alias("cyclomatic"),
        F.when(F.btrim(head) == "", 0).otherwise(F.size(F.split(head, ","))).alias("parameters"), called.alias("calls"), names(r"\bnew\s+([A-Za-z_]\w*)").alias("types"),
    )


# Names of sequence operators; those that run when they are read from, not when they are written.
SEQUENCE_OPERATORS = (
    "Where", "Select", "SelectMany", "Join", "GroupBy", "GroupJoin", "OrderBy", "OrderByDescending", "ThenBy", "ThenByDescending", "Take", "Skip", "TakeWhile", "SkipWhile",
    "First", "FirstOrDefault", "Last", "LastOrDefault", "Single", "SingleOrDefault", "Any", "All", "Count", "Sum", "Min", "Max", "Average", "Aggregate",
    "Distinct", "Union", "Intersect", "Except", "Concat", "ToList", "ToArray", "ToDictionary", "ToHashSet", "AsEnumerable", "AsQueryable", "Cast", "OfType",
)
DEFERRED_OPERATORS = (
    "Where", "Select", "SelectMany", "Join", "GroupBy", "GroupJoin", "OrderBy", "OrderByDescending", "ThenBy", "ThenByDescending", "Take", "Skip", "TakeWhile", "SkipWhile",
    "Distinct", "Union", "Intersect", "Except", "Concat", "AsEnumerable", "AsQueryable", "Cast", "OfType", "Reverse",
)


def sequence_calls(text: Column) -> Column:
    """array of struct(name, deferred): the sequence operators that a text calls, in order."""
    called = F.filter(F.regexp_extract_all(text, F.lit(r"\.([A-Z]\w*)\s*(?:<[^<>()]*>)?\("), 1), lambda n: n.isin(*SEQUENCE_OPERATORS))
    return F.transform(called, lambda n: F.struct(n.alias("name"), n.isin(*DEFERRED_OPERATORS).alias("deferred")))


def snippet(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def kind_of_pattern(pattern: str) -> str:
    """regex, wildcard or exact, from the marks in it."""
    if any(c in pattern for c in "[(^${|+") or ("." in pattern and "*" in pattern):
        return "regex"
    return "wildcard" if "*" in pattern or "?" in pattern else "exact"


def wildcard_regex(pattern: str) -> str:
    """An anchored regular expression with a group for each * and ?."""
    return "^" + "".join("(.*?)" if c == "*" else "(.)" if c == "?" else re.escape(c) for c in pattern) + "$"


def name_matches(name: Column, pattern: str, kind: str = "auto") -> Column:
    kind = kind_of_pattern(pattern) if kind == "auto" else kind
    if kind == "exact":
        return name == pattern
    return name.rlike(wildcard_regex(pattern) if kind == "wildcard" else pattern)


def rewritten(name: Column, pattern: str, replacement: str, kind: str = "auto") -> Column:
    """name with the pattern's match replaced: $n stand for groups; in wildcards, the n-th * or ? of the replacement for what the n-th of the pattern met. No match: name."""
    kind = kind_of_pattern(pattern) if kind == "auto" else kind
    if kind == "exact":
        return F.when(name == pattern, F.lit(replacement)).otherwise(name)
    if kind == "wildcard":
        n = 0
        out = ""
        for c in replacement:
            if c in "*?":
                n += 1
                out += f"${n}"
            else:
                out += "\\" + c if c in "\\$" else c
        return F.regexp_replace(name, wildcard_regex(pattern), out)
    return F.regexp_replace(name, pattern, replacement)


def glob_matches(path: Column, pattern: str) -> Column:
    """`a/**/b`: starts and ends so; with `*`, anchored and in any case; else the path ends with it or holds it, in any case."""
    if "**" in pattern:
        head, _, tail = pattern.partition("**")
        head, tail = head.rstrip("/\\"), tail.lstrip("/\\")
        met = path.startswith(head) if head else F.lit(True)
        if tail:
            met = met & (path.endswith(tail.lstrip("*")) if tail.startswith("*") else path.endswith(tail))
        return met
    if "*" in pattern:
        return path.rlike("(?i)^" + ".*".join(map(re.escape, pattern.split("*"))) + "$")
    return F.lower(path).endswith(pattern.lower()) | F.contains(F.lower(path), F.lit(pattern.lower()))


def symbol_id(document: Column, line: Column, name: Column, name_hash: Column) -> Column:
    return F.when(document.isNotNull(), F.concat_ws(":", document, line.cast("string"), name)).otherwise(F.concat(F.lit("cached:"), name_hash.cast("string")))


def relevance_of_name(name: Column, term: str) -> Column:
    low, t = F.lower(name), term.lower()
    return F.when(low == t, 1.0).when(low.startswith(t), 0.8).when(F.contains(low, F.lit(t)), 0.6).otherwise(0.4)


# Ranges of Cyrillic, CJK and kana letters.
CYRILLIC, CJK = r"[Ѐ-ӿ]+", r"[一-鿿぀-ゟ゠-ヿ㐀-䶿]"
CODE_WORDS = ("if", "else", "for", "while", "return", "new", "var", "int", "string", "bool", "void", "public", "private", "static", "class", "null", "true", "false", "this", "using")


def latin_words(text: Column, without: tuple[str, ...] = CODE_WORDS) -> Column:
    """Number of words of two ASCII letters or more that are not words of code."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b([a-zA-Z]{2,})\b"), 1)
    return F.size(F.filter(words, lambda w: ~F.lower(w).isin(*without)))


def other_words(text: Column) -> Column:
    """Number of Cyrillic words and of CJK characters."""
    return F.regexp_count(text, F.lit(CYRILLIC)) + F.regexp_count(text, F.lit(CJK))


def embedding_text(kind: Column, name: Column, signature: Column, content: Column, children: Column, most: int = 2000) -> Column:
    """What of a unit is embedded, by its kind, cut to most code points: the first line with both ends of the rest, or the start."""
    members = F.when(F.size(children) > 0, F.concat(F.lit("members: "), F.array_join(F.slice(children, 1, 10), ", "))).otherwise("")
    text = (
        F.when(kind == "File", "")
        .when(kind == "Namespace", F.concat(name, F.lit(" "), F.array_join(children, " ")))
        .when(kind == "Type", F.concat(F.coalesce(signature, F.lit("")), F.lit(" "), members))
        .when(kind.isin("Method", "JsonObject", "JsonArray", "JsonProperty"), F.concat(F.coalesce(signature, F.lit("")), F.lit("\n"), content))
        .when(kind.isin("Property", "Field"), F.coalesce(signature, content))
        .otherwise(content)
    )
    head = F.locate("\n", text)
    left = most - head - 10
    half = F.floor(left / 2).cast("int")
    body = F.substring(text, head + 1, F.length(text))
    ends = F.concat(F.substring(text, F.lit(1), head), F.substring(body, F.lit(1), half), F.lit("..."), F.substring(body, -half, half))
    return F.when(F.length(text) <= most, text).when((head > 1) & (head - 1 < most // 2) & (left > 100), ends).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def line_changes(base: Column, new: Column) -> Column:
    """struct(inserted, deleted): numbers of lines that only one side has."""
    a, b = F.split(unix_lines(base), "\n"), F.split(unix_lines(new), "\n")
    return F.struct(F.size(F.array_except(b, a)).alias("inserted"), F.size(F.array_except(a, b)).alias("deleted"))


def bloom_size(n: Column, rate: Column) -> Column:
    """struct(bits, hashes) of a Bloom filter for n keys at a false positive rate."""
    bits = F.ceil(-n * F.ln(rate) / (F.ln(F.lit(2.0)) * F.ln(F.lit(2.0))))
    return F.struct(bits.alias("bits"), F.greatest(F.lit(1), F.round(bits / n * F.ln(F.lit(2.0)))).cast("int").alias("hashes"))


def bloom_positions(key: Column, bits: int, hashes: int) -> Column:
    """array of the bits that a key sets in a Bloom filter: two halves of its md5, the second taken up to `hashes` - 1 times."""
    digest = F.md5(key)
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(half(1) + i * half(9), F.lit(bits)))
