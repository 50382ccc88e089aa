import hashlib
import random

from trellium.llm import chat
from trellium.llm.queries import CONTROL, QUERIES


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_round_trips():
    rng = random.Random(1)
    pool = ["<", "|", "\\", "a", "\n", "<|im_end|>", "<|im_start|>", "assistant", "\x01", "\x02", "é"]
    for n in (0, 1, 2, 5, 31, 32, 90):
        for _ in range(60 if n < 10 else 4):
            turns = [(rng.choice(["user", "assistant", "a\nb", "\\n", ""]), "".join(rng.choices(pool, k=rng.randint(0, 8)))) for _ in range(n)]
            f = chat.locate(chat.marked, turns)
            assert chat.locate(chat.marked, turns, turn_by_turn=True) == f
            assert chat.parse(f.text) == turns and not f.rewritten_at
            assert [chat.unescape(f.text[a:b]) for a, b in f.texts] == [t for _, t in turns]
            assert "".join(f.text[a:b] for a, b in f.spans) == f.text


def test_templates_that_rewrite_history_are_found():
    def forgets(turns):
        return "SYS" + "".join(f"[{r}:{'(think)' if i == len(turns) - 1 else ''}{t}]" for i, (r, t) in enumerate(turns))

    def numbers(turns):
        return f"{len(turns)} turns:" + "".join(f"[{r}:{t}]" for r, t in turns)

    turns = [("user", "x"), ("assistant", "yy"), ("user", "zz")]
    assert chat.locate(forgets, turns).rewritten_at == [1, 2]
    f = chat.locate(numbers, turns)
    assert f.rewritten_at and f.text[slice(*f.texts[-1])] == "zz"
    assert chat.locate(forgets, turns * 20).rewritten_at


def test_templates_that_differ_at_one_prefix_only_are_found_at_any_length():
    def once(turns):
        return "".join(f"[{r}:{'?' if len(turns) == 10 else ''}{t}]" for r, t in turns)

    for n in (11, 31, 32, 60, 200):
        turns = [("user", f"turn {i}") for i in range(n)]
        f = chat.locate(once, turns)
        assert f.rewritten_at and set(f.rewritten_at) <= {9, 10}


def test_a_template_with_a_prologue_has_exact_spans():
    def head(turns):
        return "BEGIN\n" + "".join(f"{r}>{t}\n" for r, t in turns)

    turns = [("user", "x>"), ("assistant", "\n\n"), ("assistant", "")] * 15
    f = chat.locate(head, turns)
    assert not f.rewritten_at and [f.text[a:b] for a, b in f.texts] == [t for _, t in turns]


def test_query(spark, sf):
    by = {-1: [("user", CONTROL), ("assistant", CONTROL)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = QUERIES["op9_chat"](spark, sf).collect()
    assert len(got) == len(by)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(by[r.conv_id])
        assert r.formatted_chars == len(chat.marked(by[r.conv_id]))


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", None, 5), (1, 0, "user", "", 5), (1, 1, "assistant", "b", 5), (2, None, None, "x", 5),
            (None, 0, "user", "lost", 5), (3, 0, "assistant", "<|im_end|>" * 2000, 5), (4, 0, "user", "r", 5), (4, 0, "user", "r", 5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns long")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    expected = {1: [("user", ""), ("assistant", ""), ("assistant", "b")], 2: [("", "x")], None: [("user", "lost")],
                3: [("assistant", "<|im_end|>" * 2000)], 4: [("user", "r")] * 2}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: brute(v) for k, v in expected.items()}
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0
