"""Queries that SQL cannot express, row by row against plain Python on the smallest tables."""

import hashlib
import itertools
import os
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.functions.similarity import CLASS_BASE, CLASS_COUNTS, CLASS_METHODS, CLASS_SETS, METHOD_CAPS, METHOD_WEIGHTS
from tessera.operators import merge
from tessera.plans.registry import ORACLES, QUERIES
from tessera.plans.versions import THREE
from tests.oracle import connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
BRUTE = {"clone_groups", "clone_summary", "html_units", "lsh_topk", "renames", "resolved_conflicts", "segment_hint", "semantic_match", "similar_classes", "stack_hints"}


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def rows(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect())


def test_every_query_has_sql_or_brute_force():
    assert set(QUERIES) - set(ORACLES) == BRUTE


def levenshtein(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (x != y))
    return line[-1]


def name_similarity(a, b):
    x, y = a.lower(), b.lower()
    return 1.0 if x == y else 1 - levenshtein(x, y) / max(len(x), len(y), 1)


def clones():
    """member -> (leader, similarity), as one pass in id order makes them."""
    words = {r["doc_id"]: set(re.findall("[a-z]{4,}", (r["text"] or "").lower())) for r in table("documents")}
    words = {d: w for d, w in sorted(words.items()) if w}
    alike = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b])
    led, out = {}, {}
    for d in words:
        if d in out:
            continue
        taken = [(e, alike(d, e)) for e in words if e > d and e not in out and alike(d, e) >= 0.8]
        if taken:
            out[d] = (d, 1.0)
            out |= {e: (d, s) for e, s in taken}
    return led | out


def test_clone_groups(spark):
    assert rows(spark, "clone_groups", "member", "leader", "similarity") == sorted((m, a, round(s, 6)) for m, (a, s) in clones().items())


def test_clone_summary(spark):
    groups = defaultdict(list)
    for m, (a, s) in clones().items():
        groups[a].append((m, s))
    want = []
    for a, members in groups.items():
        mean = np.mean([s for m, s in members if m != a])
        kind = next((k for least, k in ((0.98, "type-1"), (0.90, "type-2"), (0.80, "type-3")) if mean >= least - 1e-12), "type-4")
        weight = len(members) * mean
        want.append((a, len(members), round(mean, 6), kind, next((p for least, p in ((4, "critical"), (2.5, "high"), (1.5, "medium")) if weight >= least - 1e-12), "low")))
    assert rows(spark, "clone_summary", "leader", "n", "similarity", "clone_type", "priority") == sorted(want)


def methods():
    lines, out = defaultdict(list), {}
    for r in table("lineitem"):
        lines[r["l_suppkey"]].append(r)
    for k, own in lines.items():
        n = len(own)
        out[k] = {
            "invoked": {str(r["l_partkey"] % 30) for r in own}, "operations": Counter(r["l_returnflag"] for r in own), "accessed_types": {str(k % 5), str(k % 3)}, "param_types": [str(k % 2), str(k % 4)],
            "return_type": str(k % 3), "blocks": n % 60, "branches": n % 25, "loops": k % 8, "cyclomatic": n % 30,
        }
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def method_similarity(a, b):
    w = METHOD_WEIGHTS
    dot = sum(n * b["operations"][k] for k, n in a["operations"].items())
    size = lambda m: sum(n * n for n in m.values()) ** 0.5
    out = w["invoked"] * jaccard(a["invoked"], b["invoked"]) + w["operations"] * dot / (size(a["operations"]) * size(b["operations"])) + w["accessed_types"] * jaccard(a["accessed_types"], b["accessed_types"])
    out += w["param_types"] * sum(x == y for x, y in zip(a["param_types"], b["param_types"], strict=True)) / 2 + w["return_type"] * (a["return_type"] == b["return_type"]) + w["param_count"]
    return out + sum(w[k] * (1 - abs(a[k] - b[k]) / cap) for k, cap in METHOD_CAPS.items())


def test_similar_classes(spark):
    m, classes = methods(), defaultdict(list)
    for r in table("supplier"):
        classes[r["s_suppkey"] // 8].append(r["s_suppkey"])
    want = []
    for ca, cb in itertools.combinations(sorted(classes), 2):
        scores = {(a, b): method_similarity(m[a], m[b]) for a in classes[ca] for b in classes[cb] if a in m and b in m and a // 40 == b // 40}
        if not scores:
            continue
        left, right = sorted({a for a, _ in scores}), sorted({b for _, b in scores})
        flipped = len(left) > len(right)
        used, total = set(), 0.0
        for x in right if flipped else left:
            free = [(-scores[(y, x) if flipped else (x, y)], y) for y in (left if flipped else right) if y not in used]
            if free:
                best = min(free)
                used.add(best[1])
                total -= best[0]
        matched = total / min(len(left), len(right))
        sets = [{str(k % 7) for k in classes[c]} for c in (ca, cb)]
        n = [len(classes[c]) for c in (ca, cb)]
        score = CLASS_METHODS * matched + CLASS_BASE * (ca % 3 == cb % 3) + sum(CLASS_SETS.values()) * jaccard(*sets) + sum(w * (1 - abs(n[0] - n[1]) / cap) for w, cap in CLASS_COUNTS.values())
        want.append((ca, cb, round(score / (CLASS_METHODS + CLASS_BASE + sum(CLASS_SETS.values()) + sum(w for w, _ in CLASS_COUNTS.values())), 5)))
    got = [(a, b, round(s, 5)) for a, b, s in rows(spark, "similar_classes", "ca", "cb", "similarity")]
    assert want and [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], abs=2e-5)


def test_renames(spark):
    suppliers, want = table("supplier"), []
    for a in suppliers:
        best = []
        for b in suppliers:
            if a["s_nationkey"] != b["s_nationkey"]:
                continue
            new = f"New{b['s_name']}"
            balance = lambda r: str(r["s_acctbal"])
            x, y = f"call {a['s_name']} with {balance(a)}", f"call {b['s_name']} with {balance(b)}".replace(b["s_name"], new)
            plain_x, plain_y = x.replace(a["s_name"], "_"), y.replace(new, "_")
            structure = 1 - levenshtein(plain_x, plain_y) / max(len(plain_x), len(plain_y), 1)
            apart = abs(a["s_suppkey"] - b["s_suppkey"] - 3)
            place = 0.0 if a["s_suppkey"] % 5 != b["s_suppkey"] % 5 else 1.0 if apart <= 5 else 0.7 if apart <= 20 else 0.3 if apart <= 50 else 0.0
            ratio = min(len(x), len(y)) / max(len(x), len(y), 1)
            if structure >= 0.70:
                best.append((-min(1.0, max(0.0, structure + 0.05 * place + 0.05 * name_similarity(a["s_name"], new) - (0.1 if ratio < 0.7 else 0))), b["s_suppkey"]))
        if best:
            score, target = min(best)
            want.append((a["s_suppkey"], target, round(-score, 6), "High" if -score >= 0.95 else "Medium" if -score >= 0.85 else "Low"))
    got = rows(spark, "renames", "base_id", "target_id", "score", "confidence")
    assert want and [(a, b, c) for a, b, _, c in got] == [(a, b, c) for a, b, _, c in sorted(want)]
    assert [s for *_, s, _ in got] == pytest.approx([s for *_, s, _ in sorted(want)], abs=2e-6)


def test_resolved_conflicts(spark):
    sql = f"WITH {THREE} SELECT y.id, base.content AS o, ua.content AS a, ub.content AS b FROM y LEFT JOIN base ON base.id = y.id LEFT JOIN a ua ON ua.id = y.id LEFT JOIN b ub ON ub.id = y.id WHERE act = 'Conflict/both'"
    want = []
    for i, o, a, b in connect(SF).sql(sql).fetchall():
        text = merge.merged_text(o or "", a or "", b or "")
        want.append((i, hashlib.md5((text or "").encode()).hexdigest(), "conflict" if text is None else "merged"))
    assert want and rows(spark, "resolved_conflicts", "id", "merged_md5", "resolution") == sorted(want)


def test_semantic_match(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    e = {r["vec_id"]: (np.array(r["embedding"], float), r["label"]) for r in table("embeddings") if r["vec_id"] in texts}
    unit = {i: v / np.linalg.norm(v) for i, (v, _) in e.items()}
    want = []
    for a in (i for i in e if i % 20 == 0):
        near = sorted((-float(unit[a] @ unit[b]), b) for b in e if b != a and unit[a] @ unit[b] >= 0.3)[:10]
        best = []
        for s, b in near:
            x, y = len(texts[a]), len(texts[b])
            score = -s + (0.05 if e[a][1] == e[b][1] else 0) + 0.1 * name_similarity(texts[a][:12], texts[b][:12]) - (0.1 if min(x, y) / max(x, y, 1) < 0.5 else 0)
            best.append((-min(1.0, max(0.0, score)), b))
        if best and -min(best)[0] >= 0.3:
            want.append((a, min(best)[1], round(-min(best)[0], 5)))
    got = [(a, b, round(s, 5)) for a, b, s in rows(spark, "semantic_match", "base_id", "target_id", "score")]
    assert want and [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], abs=2e-5)


def symbols():
    out = {}
    for r in table("part"):
        space = f"Cat.{r['p_type']}.{r['p_brand'].replace('#', 'N')}"
        out[r["p_partkey"]] = (r["p_name"], space, f"{space}.{r['p_name'].replace(' ', '_')}" + (f"({r['p_size']})" if r["p_size"] % 5 == 0 else ""))
    return out


def fuzzy(a, b):
    x, y = a.lower(), b.lower()
    if not x or not y:
        return 0.0
    if x in y or y in x:
        return 1.0
    most = max(len(x), len(y))
    return max(0.0, 1 - (most if abs(len(x) - len(y)) > most // 2 else levenshtein(x, y)) / most)


def segments(hint, target):
    hints, targets = [s for s in re.split(r"[.,<> ()]", hint.lower()) if s], [s for s in re.split(r"[.<>]", target.lower()) if s]
    return sum(any(t in h or h in t or fuzzy(h, t) > 0.85 for h in hints) for t in targets) / len(targets) if targets else 0.0


def test_segment_hint(spark):
    want = [(i, round(segments("at Cat.ECONOMY.red_widget(int)", fqn), 6)) for i, (_, _, fqn) in symbols().items()]
    assert rows(spark, "segment_hint", "id", "score") == sorted(want)


def test_stack_hints(spark):
    def one(hint, name, kind, space, fqn):
        low = hint.lower()
        if fqn in hint:
            return 1.0
        if f"{kind}.{name}".lower() in low:
            return 0.95
        over = lambda value, least, share: share * value if value > least else 0.0
        return max(0.7 if space.lower() in low else 0.0, over(fuzzy(hint, kind), 0.8, 0.6), over(fuzzy(hint, name), 0.8, 0.5), over(segments(hint, space), 0.7, 0.65))

    hints = ("at Cat.ECONOMY.BrandN17.red_widget(int)", "in small rng")
    want = [(i, round(max(one(h, name, space.split(".")[-1], space, fqn) for h in hints), 6)) for i, (name, space, fqn) in symbols().items()]
    assert rows(spark, "stack_hints", "id", "confidence") == sorted(want)


class Tags(HTMLParser):
    """Tags of a page with the tag that each stands in, and their own texts."""

    def __init__(self):
        super().__init__()
        self.open, self.seen, self.text = [], [], Counter()

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        self.seen.append((named.get("id") or named.get("name") or tag, self.open[-1][1] if self.open else None))
        if tag not in ("br", "hr", "img", "input", "link", "meta"):
            self.open.append((tag, len(self.seen) - 1))

    def handle_endtag(self, tag):
        tags = [t for t, _ in self.open]
        if tag in tags:
            del self.open[len(tags) - 1 - tags[::-1].index(tag) :]

    def handle_data(self, data):
        if self.open and data.strip():
            at = self.open[-1][1]
            self.text[at] = f"{self.text[at]} {data.strip()}" if self.text[at] else data.strip()


def test_html_units(spark):
    want = Counter()
    for r in table("pages"):
        p = Tags()
        p.feed(r["html"])
        p.close()
        kids = Counter(parent for _, parent in p.seen)
        want.update((str(r["page_id"]), name, kids[i], hashlib.md5((p.text[i] or "").encode()).hexdigest(), parent is None) for i, (name, parent) in enumerate(p.seen))
    got = Counter((r.source_id, r.name, r.n_children, r.content_md5, r.parent_id is None) for r in QUERIES["html_units"](spark, SF).collect())
    assert want and got == want
