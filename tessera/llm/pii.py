"""Personal data: fixed rules, and candidates that boosted trees accept.

Generators propose spans in looser formats than the rules know (addresses with
the at sign spelled out, masked dots, other separators, no country code) and
spans of a kind without rules (secrets: keys, tokens, passwords); they overlap
each other and much that is harmless. Trees score a candidate by its format and
by what stands around it. They are fitted to formats that are written out at
random, wanted and harmless ones, within texts of the corpus.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import boosting
from tessera.llm.common import column_of, slices, small_batches

#: Kinds that the fixed rules know, then one that only the trees do.
RULE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*RULE_KINDS, "secret")
EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start amid digits can only follow a failure at their first one, which has the same rest
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The generators: more than the rules accept, to be scored.
AT, DOT = r"(?:@|[\[({]\s?(?:at|@)\s?[\])}]|\sat\s)", r"(?:\.|[\[({]\s?(?:dot|\.)\s?[\])}]|\sdot\s)"
LOOSE_EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9_%+-]{{0,63}}(?:{DOT}[A-Za-z0-9_%+-]{{1,63}}){{0,3}}\s?{AT}\s?[A-Za-z0-9-]{{1,63}}(?:\s?{DOT}\s?[A-Za-z0-9-]{{1,63}}){{1,4}}", re.I)
#: Where an address may be: an at sign, one in brackets, or one spelled out with a dot to follow.
EMAIL_AT = re.compile(r"@|[\[({]\s?at\s?[\])}]|\sat\s(?=\S+\s?(?:[\[({]|\sdot\s|dot\s)|[a-z0-9-]+\.[a-z0-9])", re.I)
LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?[0-9]{1,3}){3}(?![0-9])", re.I)
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\+|00)?\(?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9])")
LOOSE_SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}")
#: Code points before and behind an at sign within which LOOSE_EMAIL begins and ends: the most that its parts can have.
BEFORE_AT, BEHIND_AT = 290, 370
HINTS = {
    "email": re.compile(r"mail|contact|write|reach|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|addr", re.I),
    "card": re.compile(r"card|visa|karte|tarjeta|carte|credit|pay", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|ring|anruf|llam|appel", re.I),
    "secret": re.compile(r"token|secret|passw|pwd|credential|bearer|auth|key", re.I),
}
HARMLESS = re.compile(r"version|\bv$|order|invoice|isbn|part|serial|total|date|\bid\b|page|price|[$€£]\s?$|commit|sha|md5|checksum|hash|file|path|url", re.I)
#: Words before a spelled-out at that tell of a place, not of a mailbox.
PLACES = ("look", "looking", "more", "us", "only", "available", "online", "visit", "found", "hosted", "see", "it", "is", "was", "are", "here", "them", "out", "live", "site", "website", "page", "blog", "store", "read", "learn", "work", "works", "working", "based")
AT_PLACE = re.compile(rf"(?:{'|'.join(PLACES)})\sat\s", re.I)
#: Code points before a candidate that count as its context.
AROUND = 24
#: Share of accepted candidates that must be right on texts that were not fitted to.
PRECISION = 0.98
#: Texts that formats are written into, stretches of each (anywhere in the whole text) and their code points; formats for each kind, wanted and harmless; share of them for the thresholds.
SAMPLE_ROWS, STRETCHES, STRETCH, FORMATS, HELD = 400, 4, 80, 500, 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed rules, by start, then kind; those of a kind don't overlap."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_HEAD:
            start -= 1
        m = EMAIL_TAIL.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data; they overlap."""
    out = []
    for m in EMAIL_AT.finditer(text):
        a, b = max(0, m.start() - BEFORE_AT), min(len(text), m.end() + BEHIND_AT)
        out.extend(("email", a + x.start(), a + x.end()) for x in LOOSE_EMAIL.finditer(text[a:b]) if a + x.start() < m.end() and a + x.end() > m.start())
    if "[" in text or "(" in text or "{" in text:
        out.extend(("ip", *m.span()) for m in LOOSE_IP.finditer(text))
    out.extend(("card", *m.span()) for m in LOOSE_CARD.finditer(text))
    out.extend(("phone", *m.span()) for m in LOOSE_PHONE.finditer(text))
    out.extend(("secret", *m.span()) for m in LOOSE_SECRET.finditer(text) if any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])))
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + 2]
    digits = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    gaps = re.findall(r"[^0-9A-Za-z]+", s)
    last = re.findall(r"[A-Za-z]+", s)[-1:] or [""]
    char = lambda c: 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3
    return [
        KINDS.index(kind), end - start, len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(gaps), len(set(gaps)),
        s[:1] == "+", s[:2] == "00", "(" in s and ")" in s, "-" in s, "." in s, "/" in s, "@" in s, bool(re.search(r"[\[({]\s?(?:at|@)", s, re.I)), bool(re.search(r"[\[({]\s?(?:dot|\.)", s, re.I)),
        " at " in s.lower(), " dot " in s.lower(), len(last[0]), last[0].islower(), luhn(digits) if digits else -1, all(int(g[:9]) <= 255 for g in groups) if groups else -1,
        bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}.*|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}.*", s)),
        [len(g) for g in groups] in ([4, 4, 4, 4], [4, 6, 5]), [len(g) for g in groups][-2:] in ([3, 4], [2, 2], [4, 4]), len(set(digits)),
        bool(HINTS[kind].search(before)), bool(HARMLESS.search(before)), before[-1:] in "\"'=:" and before != "", len(set(s)) / (end - start), sum(map(str.isupper, s)), "_" in s, bool(re.fullmatch(r"[0-9a-fA-F-]+", s)), char(before[-1:]), char(after[:1]), after[:1] in ".," and char(after[1:2]) == 1, bool(AT_PLACE.match(s)),
    ]


class PiiModel:
    """Trees and, by kind, the probability from which a candidate is accepted."""

    def __init__(self, trees: boosting.BoostedTrees, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def spans(self, text: str) -> list[tuple[str, int, int, bool, float]]:
        """(kind, start, end, whether a rule found it, probability): the rules' spans, and accepted candidates that overlap none of them nor a likelier one."""
        found = [(*s, True, 1.0) for s in rule_spans(text)]
        starts = [a for _, a, *_ in found]
        reach = list(itertools.accumulate((b for _, _, b, *_ in found), max))
        free = lambda c: not (at := bisect.bisect_left(starts, c[2])) or reach[at - 1] <= c[1]
        loose = [c for c in candidates(text) if free(c)]
        if loose:
            p = self.trees.probabilities(np.array([features(text, *c) for c in loose], float))
            kept: list[tuple[int, int]] = []
            for i in sorted(range(len(loose)), key=lambda i: (-p[i], loose[i][1], loose[i][1] - loose[i][2])):
                kind, a, b = loose[i]
                # Those kept do not overlap, so only the last that begins before b can reach a
                at = bisect.bisect_left(kept, (b, 0))
                if p[i] >= self.thresholds[kind] and not (at and kept[at - 1][1] > a):
                    found.append((kind, a, b, False, float(p[i])))
                    kept.insert(at, (a, b))
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _written(rng: np.random.Generator, kind: str, wanted: bool) -> str:
    """A format of this kind, or a harmless one that its generator proposes."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(3, 9)))
    if kind == "email":
        if wanted:
            at, dot = pick(("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), ("{at}", "."), (" (at) ", "."), ("[@]", "."), (" at ", "."), (" [AT] ", " [DOT] "), ("(AT)", "(DOT)"), (" AT ", " DOT "))
            return f"{word()}{pick('', '.' + word(), n(2))}{at}{word()}{dot}{pick('com', 'org', 'net', 'de', 'io')}"
        return pick(f"{word()} at {word()} dot {word()}ing", f"{word()} (at) {word()}", f"{word()}@{word()}", f"{word()} at {word()}. {word().title()}", f"{word()} at {word()}.{word().title()}", f"{pick(*PLACES)} at {pick('www.', '')}{word()}.{pick('com', 'org', 'net')}", f"@{word()} . {word()}")
    if kind == "ip":
        parts = [str(rng.integers(0, 256 if wanted else 1000)) for _ in range(4)]
        if not wanted:
            parts[rng.integers(4)] = str(rng.integers(256, 1000))
        return pick("[.]", "(.)", "[dot]", " [.] ").join(parts)
    if kind == "card":
        body = pick("4", "51", "37") + n(12)
        body = body[:15] if wanted else n(pick(13, 15, 16, 17))
        if wanted:
            body += next(str(d) for d in range(10) if luhn(body + str(d)))
        sep = pick(".", "/", "_", " - ", "  ", "-", " ")
        return pick(sep.join(body[i : i + 4] for i in range(0, len(body), 4)), body if not wanted else sep.join(body[i : i + 4] for i in range(0, len(body), 4)))
    if kind == "secret":
        run = lambda letters, k: "".join(letters[i] for i in rng.integers(0, len(letters), k))
        hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        if wanted:
            return pick(run(hexes, 40), run(hexes, 32), run(mixed, 40), run(mixed, 24), f"sk-{run(mixed, 32)}", f"AKIA{run(mixed[:26] + mixed[52:], 16)}", f"ghp_{run(mixed, 36)}")
        return pick(run(hexes, 40), run(hexes, 8) + "-" + "-".join(run(hexes, 4) for _ in range(3)) + "-" + run(hexes, 12), f"{word()}-{word()}-{word()}-{n(2)}", f"{word()}/{word()}/{word()}_{n(3)}", f"{word()}{word()}{word()}{n(1)}", f"{word()}_{n(4)}_{n(2)}_{n(2)}_{word()}")
    if wanted:
        return pick(f"({n(3)}) {n(3)}-{n(4)}", f"00{rng.integers(10, 99)} {n(3)} {n(7)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(3)}/{n(7)}", f"{n(3)}.{n(3)}.{n(4)}")
    return pick(f"20{n(2)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", n(8), n(10), f"{n(2)}.{n(1)}.{n(4)}.{n(2)}", f"{n(3)} {n(2)} {n(1)} {n(3)}", f"{n(16)}", f"{n(4)}-{n(6)}", f"{rng.integers(10, 29)}.{rng.integers(10, 13)}.20{n(2)}", n(12))


def train(texts: list[str], seed: int = 5) -> PiiModel:
    """Trees on formats written into stretches of texts, thresholds for PRECISION on those that were held out. Texts may be few or empty."""
    rng = np.random.Generator(np.random.PCG64(seed))
    hints = {"email": ("mail:", "contact", ""), "ip": ("server", "ip", "host", ""), "card": ("card", "visa:", ""), "phone": ("call", "tel.", "phone:", ""), "secret": ('token = "', "api_key: ", "password=", "secret:", "Authorization: Bearer", 'key="')}
    plain = [t for t in texts if t] or ["and the of in to"]
    x, y, kinds = [], [], []
    for kind in KINDS:
        for i in range(2 * FORMATS):
            wanted = i % 2 == 0
            text = plain[rng.integers(len(plain))]
            at = int(rng.integers(0, len(text) + 1))
            hint = hints[kind][rng.integers(len(hints[kind]))] if wanted or rng.random() < 0.1 else ("order", "version", "id", "part no.", "", "", "", "date", "commit", "sha1:", "file", "url")[rng.integers(12)]
            s = _written(rng, kind, wanted)
            glue = "" if hint[-1:] in ('"', "=") else " "
            head = f"{text[max(0, at - 40) : at]} {hint}{glue}" if hint else f"{text[max(0, at - 40) : at]} "
            mark = '"' if hint.endswith('"') else (".", "", ",", " ")[rng.integers(4)]
            whole = f"{head}{s}{mark} {text[at : at + 40]}"
            span = (len(head), len(head) + len(s))
            for c in candidates(whole):
                over = c[1] < span[1] and span[0] < c[2]
                if over or rng.random() < 0.5:
                    x.append(features(whole, *c))
                    y.append(wanted and c[0] == kind and c[1:] == span)
                    kinds.append(c[0])
    x, y, kinds = np.array(x, float), np.array(y, float), np.array(kinds)
    held = rng.random(len(y)) < HELD
    trees = boosting.fit(x, y, held)
    p, thresholds = trees.probabilities(x[held]), {}
    for kind in KINDS:
        own = kinds[held] == kind
        order = np.argsort(-p[own])
        right = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        thresholds[kind] = float(max(0.5, p[own][order][good[-1]])) if len(good) else 2.0
    return PiiModel(trees, thresholds)


def train_on(docs: DataFrame, rows: int = SAMPLE_ROWS) -> PiiModel:
    """train() on stretches from anywhere in so many texts of docs at most, those whose doc_id has the smallest hash; formats are written into them. A doc_id that repeats gives no more stretches."""
    # Ids first: a task would send its own `rows` texts to the driver otherwise
    picked = docs.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce(column_of(docs, "text", "string"), F.lit(""))
    place = F.pmod(F.xxhash64("doc_id", "nth"), F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1).cast("int") + 1
    chosen = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id").withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(STRETCHES))))
    found = chosen.select("doc_id", "nth", F.substring("text", place, F.lit(STRETCH)).alias("stretch")).groupBy("doc_id", "nth").agg(F.min("stretch").alias("stretch"))
    return train([r.stretch for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", "nth").collect()])


SPANS = "array<struct<kind:string,start:bigint,end:bigint,by_rule:boolean,probability:double>>"


def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive; by_rule; probability), by start, then kind (as in KINDS): one row for each row of docs, rows that repeat too.

    Null and empty texts have no spans; texts are read whole, however long. Of candidates that overlap the likeliest stays (ties: the first, then the longest). Columns besides doc_id and text are not
    read, whatever their names. Empty table: empty result.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = ("kind", "start", "end", "by_rule", "probability")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("by_rule", pa.bool_()), ("probability", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans = [[dict(zip(fields, s, strict=True)) for s in sent.value.spans(t)] if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column_of(docs, "text", "string").alias("text"))
    return rows.mapInArrow(find, f"doc_id long, spans {SPANS}")


def redact(text: str, spans: list[tuple]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out.append(text[at:start] + f"[{kind}]")
        at = max(at, end)
    return "".join(out) + text[at:]
