import random
import re
from collections import Counter

from quillon.llm import licenses


def base(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def brute_labels(rows, rarest=8, agree=0.6):
    """The method on word lists: every begin of every template is tried."""
    files = {i: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    rare = [{w for w, t, _ in licenses.index() if t == k} for k in range(len(licenses.TEMPLATES))]
    df = Counter(w for ws in files.values() for w in set(ws))
    out = {}
    for i, ws in files.items():
        out[i] = set()
        for k, (label, keys, notice) in enumerate(licenses.TEMPLATES):
            seq, n = notice.split(), min(len(rare[k]), rarest)
            asked = set(sorted(rare[k] & set(ws), key=lambda w: (df[w], w))[:rarest])
            for b in range(-len(seq), len(ws)):
                agreed = {w for p, w in enumerate(seq) if w in asked and 0 <= b + p < len(ws) and ws[b + p] == w}
                if len(agreed) / n >= agree - 1e-9:
                    spots = [(b + next(x for x in range(len(seq)) if seq[x : x + len(key.split())] == key.split()), key.split()) for key in keys]
                    if all(s >= 0 and ws[s : s + len(key)] == key for s, key in spots):
                        out[i].add(label)
    return out


def test_labels_equal_brute_force(spark):
    r = random.Random(11)
    rows = [(0, None), (1, "")]
    for i in range(2, 160):
        parts = []
        for _ in range(r.randrange(1, 4)):
            words = r.choice(licenses.TEMPLATES)[2].split()
            a = r.randrange(0, max(1, len(words) // 3))
            words = words[a : len(words) - r.randrange(0, max(1, len(words) // 3))]
            for _ in range(r.choice((0, 0, 1, 2))):
                words[r.randrange(len(words))] = r.choice(["acme", "software", "license", "2", "the"])
            parts.append(" ".join(words))
        rows.append((i, "; ".join(parts)))
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_labels(rows)
    for i, t in rows:
        assert set(filter(None, got[i].labels.split(","))) == want[i] | set(filter(None, base(t)[4].split(",")))
    assert sum(map(bool, want.values())) > 60


def test_base_equals_brute_force(spark):
    r = random.Random(7)
    vocab = ["mit", "License", "APACHE", "general", "public", "license", "GNU", "été", "x"]
    rows = [(0, None), (1, ""), (2, "mit-license"), (3, "license mit license license")]
    rows += [(i, "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "_"]) for _ in range(r.randrange(60)))) for i in range(4, 80)]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == base(t)
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1


def test_every_template_is_found_in_place_and_only_there(spark):
    rows = [(k, f"some words before. {notice.upper()}, and after it") for k, (_, _, notice) in enumerate(licenses.TEMPLATES)]
    rows += [(100 + k, " ".join(reversed(notice.split()))) for k, (_, _, notice) in enumerate(licenses.TEMPLATES)]
    rows += [(200, "Licensed under CC BY-NC 4.0."), (201, "permission is not granted to sell copies")]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k].labels.split(",") and got[k].score > 0.6
        assert label not in got[100 + k].labels.split(",") or label in got[100 + k].base_labels
    assert got[200].labels == "cc-by-nc-4.0" and got[201].labels == "" and got[201].score == 0


def test_empty_table_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, words string, row int, keys string"
    assert licenses.scan(spark.createDataFrame([], schema)).collect() == []
    got = licenses.scan(spark.createDataFrame([(1, "MIT License", "x", 1, "k")] * 2 + [(None, None, None, None, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in got) == [(0, 0), (1, 1), (1, 1)]


def test_notices_of_one_file_are_all_found(spark):
    notices = licenses.TEMPLATES
    pairs = [(a, b) for a in range(len(notices)) for b in range(len(notices)) if a != b]
    rows = [(i, f"{notices[a][2]} -- {notices[b][2]}") for i, (a, b) in enumerate(pairs)]
    rows.append((len(pairs), " ... ".join(n for _, _, n in notices)))
    rows.append((len(pairs) + 1, "word " * 300_000 + notices[1][2] + " word" * 100_000 + " " + notices[17][2]))
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert {notices[a][0], notices[b][0]} <= got[i]
    assert got[len(pairs)] >= {label for label, _, _ in notices}
    assert got[len(pairs) + 1] == {"mit", "bsd-3-clause"}
