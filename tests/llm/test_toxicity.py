import itertools
import random

import pytest

from trellium.llm import toxicity
from trellium.llm.queries import QUERIES


def weight(clause):
    lexicon, machine = toxicity.Lexicon({}, {}), toxicity.grammar()
    return machine.clause([lexicon[w] for w in toxicity.TOKEN.findall(clause.lower())])


def test_insults_need_a_target():
    aimed, alone = weight("you are stupid"), weight("the idiot light came on")
    assert aimed > 1 > alone > 0
    assert weight("they are worthless scum") > aimed
    assert weight("stupid people everywhere") == weight("you idiot") == weight("no, you idiot") == aimed
    assert weight("not a stupid plan") < alone
    assert weight("he said you are stupid") < aimed and weight('the word "stupid" is here') < alone
    assert weight("what an idiot") > 1 > weight("an idiot of some kind went past the house")
    assert weight("such a waste of space you are") == aimed and weight("a waste of time you are") == 0
    assert weight("a fine day") == 0


def test_threats_need_a_target():
    plain = ["kill the process", "they burn wood", "you will kill it on stage", "we shot a film", "they beat the drum", "it hurt", "wir schlagen vor"]
    assert [c for c in plain if weight(c)] == []
    aimed = ["i will kill you", "i kill you", "we will burn them", "kill all of them", "wir töten euch", "wir werden euch alle töten",
             "te voy a matar", "je vais te tuer", "you will be shot", "they should get beaten", "watch your back", "kill him"]
    assert [c for c in aimed if weight(c) < 1] == []
    assert weight("i will kill you") > weight("kill them")
    assert weight("i will never kill you") < 0.5 and weight("he said he will kill you") < 1
    assert weight("kill time, you know") == 0


def brute(symbols):
    """The grammar read off each pair of words of a clause."""
    total, seen = 0.0, False
    for i, s in enumerate(symbols):
        if s not in "IH":
            continue

        def within(kind, scope, j, bounded=True):
            return symbols[j] in kind and 0 < i - j <= scope and not (bounded and "," in symbols[j:i])

        before = range(i)
        negated = any(within("N", 3, j) and "N" not in symbols[j + 1 : i] for j in before)
        reported = "R" in symbols[:i] or symbols[:i].count("Q") % 2 == 1
        after = any(symbols[j] in "TD" and j - i <= 4 and "," not in symbols[i:j] for j in range(i + 1, len(symbols)))
        target = any(within("TD", 4, j, False) for j in before)
        object_ = any(within("D", 3, j) for j in before)
        passive = any(within("B", 2, j, False) and set("TD") & set(symbols[:j]) and "B" not in symbols[j + 1 : i] for j in before)
        words = [x for x in symbols if x not in ",Q"]
        call = len([x for x in symbols[: i + 1] if x not in ",Q"]) <= 3 and all(x == "Q" for x in symbols[i + 1 :])
        if s == "H":
            weight = (2.0 if "S" in symbols[:i] else 1.5) if after or object_ or passive else 0.0
        else:
            weight = 1.5 if after or target else 1.2 if call else 1.0 if seen else 0.4
        assert words
        seen = seen or weight > 0
        total += weight * (0.2 if negated else 1) * (0.5 if reported else 1)
    return total


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_machines_equal_the_grammar_on_all_short_clauses(length):
    machine = toxicity.grammar()
    for symbols in itertools.product("IHTDSBNRQ,O", repeat=length):
        assert machine.clause([(s, 1.0) for s in symbols]) == pytest.approx(brute(symbols)), symbols


def test_machines_equal_the_grammar_on_long_clauses():
    machine, rng = toxicity.grammar(), random.Random(2)
    for _ in range(20_000):
        symbols = rng.choices("IHTDSBNRQ,OOO", k=rng.randint(5, 14))
        assert machine.clause([(s, 1.0) for s in symbols]) == pytest.approx(brute(symbols)), symbols


def test_phrases_are_found_wherever_they_begin():
    machine = toxicity.phrase_machine(["a b a c", "b b"], "I")
    rng = random.Random(4)
    for _ in range(2000):
        words = rng.choices("abcd", k=12)
        state, out = machine.start, []
        for w in words:
            state, written = machine.step(state, f"{w}=O" if w != "d" else "O")
            out.append(written.endswith("I"))
        text = "".join(words)
        assert out == [text[: i + 1].endswith(("abac", "bb")) for i in range(12)]


@pytest.fixture(scope="module")
def trained(spark):
    """Invented insults of two kinds of text, learned from two thirds of the labels."""
    bad = [f"the grobnak {i} went there. a vulpish thing it is" for i in range(200)]
    good = [f"the garden {i} grew there. a gentle thing it is" for i in range(400)]
    rows = [(i, t, int(t in set(bad))) for i, t in enumerate(bad + good)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return docs, labels, toxicity.fit(docs, labels)


def test_lexicon_is_learned_and_held_out_rows_are_right(trained):
    docs, labels, model = trained
    assert "grobnak" in model.words and "garden" not in model.words
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out")
    assert got.count() > 100 and got.where("predicted = toxic").count() == got.count()


def test_held_out_labels_are_not_learned(spark, trained):
    docs, labels, model = trained
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - labels.toxic).otherwise(labels.toxic))
    assert toxicity.fit(docs, flipped) == model


def test_accuracy_on_held_out_rows(spark):
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("test tables are not here")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    english = spark.read.parquet(f"{path}/documents.parquet").where("lang = 'en'").select("doc_id")
    got = QUERIES["op10_toxicity"](spark, path).where("held_out").join(labels, "doc_id").join(english, "doc_id")
    toxic = got.where("toxic = 1").count()
    assert got.where("toxic = 1 and predicted = 1").count() >= 0.8 * toxic
    assert got.where("toxic = 0 and predicted = 1").count() <= 0.05 * toxic + 1


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (3, 0), (3, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).count() == odd.count()
