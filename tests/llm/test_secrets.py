import hashlib
import random
import re

import pytest

from trellium.llm import secrets
from trellium.llm.queries import QUERIES

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text)
             if len(m.group(2)) >= 6 and m.group(1).isascii()]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_spans_equal_brute_force():
    rng = random.Random(3)
    parts = ["token", "API_KEY", "password", "secret", " ", ":", "=", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP12", "abc123", "0" * 12,
             "deadbeef" * 3, "x", "\n", "é", "/+", "pass", "wd"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        got = sorted(secrets.base_spans(text), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert got == brute(text), text


def test_dropped_matches_use_up_their_text():
    assert secrets.base_spans("token: token: abcdefgh") == []
    assert secrets.base_spans("Key apiKey=abcdefgh") == []


def test_guess_costs():
    cost = secrets.guess_cost
    for weak in ("password", "P@ssw0rd", "qwerty123", "20230415", "aaaaaaaaaaaaaaaa", "abcabcabcabc", "dragon1990", "drowssap"):
        assert cost(weak) < secrets.SECRET_COST / 1.5, weak
    for strong in ("xK9#mQ2$vL5n", "04dbebab91ab85687d33", "Tq8zLw3vPx7Rb"):
        assert cost(strong) >= secrets.SECRET_COST, strong
    assert cost("") == 0 and cost("ab") <= 2 + secrets.PART
    assert cost("x7q" + "password") < cost("x7q") + cost("password") + 0.01


def test_cheapest_segmentation_equals_all_segmentations():
    """The minimum over every way to cut a value, part by part."""
    for value in ("dragon2012", "aaab12", "qwe7love", "1999xx"):
        parts = {}
        words = secrets.BUILT_IN
        for found in (secrets._word_parts(value, words), secrets._unknown_parts(value, words), secrets._date_parts(value),
                      secrets._walk_parts(value), secrets._repeat_parts(value, words)):
            for start, end, cost in found:
                parts[start, end] = min(cost, parts.get((start, end), 99))

        def best(at, brute_before):
            if at == len(value):
                return 0.0
            ways = [best(at + 1, True) + secrets.BRUTE_CHARACTER + (0 if brute_before else secrets.PART)]
            ways += [best(end, False) + cost + secrets.PART for (start, end), cost in parts.items() if start == at]
            return min(ways)

        assert secrets.guess_cost(value) == pytest.approx(best(0, False))


def test_method_adds_spans_and_keeps_base():
    text = 'pwd: "xK9#mQ2$vL5n" pwd: dragon token = zq7Lw3vPx7Rb http://u:pXq83kd91ma@h/ the secret: understanding'
    spans = secrets.find_secrets(text)
    assert [s for s in spans if s[0] != "guess"] == brute(text)
    values = [text[a:b] for kind, a, b in spans if kind == "guess"]
    assert "xK9#mQ2$vL5n" in values and "pXq83kd91ma" in values and "dragon" not in values
    hidden = secrets.redact(text)
    assert "xK9#" not in hidden and "pwd: dragon" in hidden and "token = [secret]" in hidden


def test_letters_and_short_random_values_are_secrets():
    for text, value in (
        ("postgres://admin:QxZvKwPtRmNbLsHd@db", "QxZvKwPtRmNbLsHd"), ("pwd=QxZvKwPtRmNbLs", "QxZvKwPtRmNbLs"),
        ("Authorization: Bearer kqzvwxjpfhgtrm", "kqzvwxjpfhgtrm"), ("password=x9$Kq2!z", "x9$Kq2!z"),
        ("pwd: k3x9q2vzt", "k3x9q2vzt"), ("pwd: k3xvq2vz", "k3xvq2vz"),
    ):
        at = text.index(value)
        assert ("guess", at, at + len(value)) in secrets.find_secrets(text), text
        assert value not in secrets.redact(text)
    for prose in ("pwd: understanding", "auth: required", "passphrase: correcthorse", "credentials: missing", "pwd: dragon",
                  "Authorization: Bearer token", "pwd: 12345678"):
        assert secrets.find_secrets(prose) == [], prose


def test_random_values_of_eight_and_nine_characters():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for alphabet in (letters, letters + letters.upper(), letters + "0123456789", letters + letters.upper() + "0123456789!#$%&*"):
        costs = [secrets.guess_cost("".join(rng.choices(alphabet, k=rng.choice((8, 9))))) for _ in range(300)]
        # Some hold a word or a walk by chance and are cheaper for it.
        assert sum(c >= secrets.SECRET_COST for c in costs) > 0.85 * len(costs), alphabet


HARMLESS = """
secret: patience|token: iterator|token=separator|the secret: kindness|secret: Grundlagen|credentials: include|auth: middleware
access_key=readonly|pwd=/home/user/projects|secret = settings.SECRET_KEY|password = getpass.getpass()|api_key = os.environ['API_KEY']
token = tokenizer|token: placeholder|password: required|passwd: unchanged|secret=config.secret|token = request.token|auth: disabled
pwd=../data/files|password: string|token = parser.nextToken()|secret: discipline|password = user.password|api_key: optional
private_key = load_private_key(path)|token=session.accessToken|auth: basic|password: Geheimnis|secret: Verantwortung|token: tokens
password = input()|pwd: /var/log/messages|the secret: listening|secret: moderation|token: identifier|credential: passport
access_key = credentials.access_key|password: letmein|token: delimiter|password: 12345678|token = null|secret: none|token: whitespace
passphrase: sunshine|pwd = os.getcwd()|password: contraseña|auth: optional|api_key = self.api_key|password=changeme
""".replace("\n", "|").strip("|").split("|")


def test_precision_and_recall():
    """Fifty harmless lines, and fifty random values of known size: ten to sixteen characters of 36, 62 or 70."""
    assert len(HARMLESS) == 50
    flagged = [line for line in HARMLESS if any(kind == "guess" for kind, _, _ in secrets.find_secrets(line)) or secrets.redact(line) != line]
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = (letters + "0123456789", letters + letters.upper() + "0123456789", letters + letters.upper() + "0123456789!#$%&*+-")
    names = ("password=", "token: ", "pwd = ", "secret: ", "api_key=", "auth: ", "access_key=")
    dear = [names[i % 7] + "".join(rng.choices(alphabets[i % 3], k=rng.randint(10, 16))) for i in range(50)]
    found = [line for line in dear if secrets.redact(line).endswith("[secret]")]
    assert flagged == []
    assert len(found) >= 48


def test_corpus_words_are_cheap_and_its_secrets_are_not(spark):
    texts = [f"the blorvik number {i} is a blorvik of xqzrtk. token = qvxkzjwpt" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words = secrets.corpus_words(docs)
    assert words[0] in ("blorvik", "number", "the", "xqzrtk", "token") and "qvxkzjwpt" not in words
    assert secrets.guess_cost("xqzrtk", secrets.Dictionary(words)) < 2 < secrets.guess_cost("xqzrtk")
    masked = {r.text for r in secrets.mask_secrets(docs).collect()}
    assert all(t.endswith("token = [secret]") for t in masked)
    assert secrets.corpus_words(docs.limit(0)) == []


def test_columns_named_like_helpers(spark):
    docs = spark.createDataFrame([("pwd=k3x9q2vzt", "a", "b", 1)], "text string, __text string, masked string, MASKED_ int")
    assert [tuple(r) for r in secrets.mask_secrets(docs).collect()] == [("pwd=[secret]", "a", "b", 1)]


def test_query_equals_brute_force(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_secrets"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute(rows[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_odd_rows_and_masking(odd, none):
    assert secrets.digest(secrets.scan(odd)).count() == odd.count()
    masked = secrets.mask_secrets(odd)
    assert masked.columns == odd.columns
    assert sorted(map(repr, masked.collect())) == sorted(map(repr, odd.collect()))
    assert secrets.mask_secrets(none).count() == 0


def test_masking_follows_length(spark):
    docs = spark.createDataFrame([(1, "token=zq7Lw3vPx7", 16), (2, "nothing", 99), (3, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.mask_secrets(docs).collect()}
    assert got == {1: ("token=[secret]", 14), 2: ("nothing", 99), 3: (None, 0)}


def test_workers_let_go_of_the_words(spark, odd, held):
    secrets.mask_secrets(odd).collect()
    # The built-in words stay.
    assert held("trellium.llm.secrets", "Dictionary") == 1
