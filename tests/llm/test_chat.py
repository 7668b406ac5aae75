import random

from quillon.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    seq = {c: tuple((r, t) for _, r, t in sorted(x, key=lambda y: y[0])) for c, x in convs.items()}
    out = []
    for c, s in seq.items():
        same = [d for d in seq if seq[d] == s]
        if c == min(same) and not any(len(o) > len(s) and o[: len(s)] == s for o in seq.values()):
            out.append((c, len(s), len(same), "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in s)))
    return sorted(out)


def test_snapshots_collapse(spark):
    r = random.Random(1)
    rows, c = [], 0
    for _ in range(25):
        base = [(("user", "assistant")[i % 2], r.choice(["hi", "ok", None, "long text é", ""])) for i in range(r.randrange(1, 9))]
        for _ in range(r.randrange(1, 5)):
            c += 1
            rows += [(c, i, *t) for i, t in enumerate(base[: r.randrange(1, len(base) + 1)])]
    r.shuffle(rows)
    got = sorted(map(tuple, chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows) and len(got) < c


def test_nulls_repeats_and_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None)]
    got = chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n_turns string")).collect()
    assert sorted((r.conv_id or -1, r.n_turns) for r in got) == [(1, 2), (2, 1)]  # the null conversation is a prefix of 1
