import hashlib
import random

from pyspark.sql import functions as F

from lambertlake.llm import chat_format as cf

ROWS = [
    (1, 0, "system", "be \\ kind <|im_end|>\n"),
    (1, 1, "user", "a" * 900),
    (1, 2, "assistant", "short <\\| and <\\\\| and <| \\"),
    (1, 3, "user", "why?"),
    (1, 4, "assistant", "é😀" * 700),
    (1, 5, "user", "<|im_start|>assistant\nno<|im_end|>\n"),
    (1, 6, "assistant", "x" * 5000),
    (1, 7, "user", None),
    (1, 8, "assistant", ""),
    (2, 0, "assistant", "again"),
    (2, 0, "assistant", "again"),
    (3, None, "na\nme", "\\<|"),
    (None, 0, None, None),
    (4, 0, "system", "alone"),
]


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), digest(loss))
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string"
    )


def test_round_trip(spark):
    for budget, history in ((512, 128), (60, 30), (1, 0), (100000, 10)):
        got = cf.read_back(cf.format_windows(frame(spark, ROWS), budget, history)).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(ROWS)


def test_windows(spark):
    turns = [(1, 0, "system", "s" * 16)] + [(1, i, "user" if i % 2 else "assistant", str(i % 10) * 40) for i in range(1, 30)]
    quarter = lambda text: F.ceil(F.char_length(text) / 4).cast("long") + 4
    got = cf.format_windows(frame(spark, turns), budget=80, history=30, tokens=quarter).orderBy("window").collect()
    assert len(got) > 5
    for r in got:
        parts = r.formatted.split("<|im_start|>")[1:]
        assert parts[0] == "system\n" + "s" * 16 + "<|im_end|>\n"
        assert sum(-(-len(p.split("\n")[1].removesuffix("<|im_end|>")) // 4) + 4 for p in parts) <= 80
        assert r.n_repeated == (0 if r.window == 0 else 3)


def naive_windows(costs, system, budget, history):
    """(first new turn, turns of history) of each window, adding up one turn after the other."""
    first = int(system and len(costs) > 1)
    room = max(1, budget - (costs[0] if first else 0))
    out, used = [], 0
    for i in range(first, len(costs)):
        if i == first or used + costs[i] > room:
            back = 0
            for n in (1, 2):
                past = sum(costs[max(first, i - n) : i])
                if back == n - 1 and i - n >= first and past <= history and past + costs[i] <= room:
                    back = n
            out.append((i, back))
            used = sum(costs[i - back : i])
        used += costs[i]
    return out


def test_windows_are_those_of_running_totals(spark):
    rng = random.Random(2)
    rows, wanted = [], {}
    for c in range(60):
        n, system = rng.randint(1, 25), rng.random() < 0.5
        texts = [" ".join("word" for _ in range(rng.choice([0, 1, 5, 20, 60]))) for _ in range(n)]
        rows += [(c, i, "system" if system and i == 0 else rng.choice(["user", "assistant"]), t) for i, t in enumerate(texts)]
        wanted[c] = naive_windows([len(t.split()) + 4 for t in texts], system, 70, 30)
    got = {}
    for r in cf.format_windows(frame(spark, rows), budget=70, history=30).orderBy("conv_id", "window").collect():
        first = int(r.formatted.startswith("<|im_start|>system") and len(wanted[r.conv_id]) > 0 and len([x for x in rows if x[0] == r.conv_id]) > 1)
        back = r.n_repeated - first if r.window else 0
        fresh = r.formatted.count("<|im_start|>") - first - back
        at = sum(f for *_, f in got.get(r.conv_id, [])) + first
        got.setdefault(r.conv_id, []).append((at, back, fresh))
    assert {c: [w[:2] for w in x] for c, x in got.items()} == wanted


def test_empty(spark):
    assert cf.read_back(cf.format_windows(frame(spark, []))).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = cf.op10_chat_format(spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
