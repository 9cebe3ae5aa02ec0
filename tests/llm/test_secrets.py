import math
import random

from marketladder.llm import secrets
from tests.llm.helpers import table

KEY = "AKIA" + "ABCDEFGH12345678"
DIGEST = "0123456789abcdef01234567"
TOKEN = "q8Zr2LkP0xWv7TnB3sYh"


def test_base_patterns():
    text = f'PassWord = "hunter22" api_key:abc12 apikey={TOKEN} x{KEY}9 {DIGEST} {DIGEST[:23]} AKIA123'
    spans = [(k, text[s:e]) for k, s, e in secrets.base_spans(text)]
    assert spans == [("assign", 'PassWord = "hunter22'), ("assign", f"apikey={TOKEN}"), ("access", KEY + "9"), ("hex", DIGEST)]
    assert secrets.base_spans("ſecret=abcdefgh toKen=abcdefgh") == []  # only ASCII letters fold
    assert [s[1:] for s in secrets.base_spans("token=token=abcdef")] == [(0, 18)]


def test_windows_equal_plain_entropy():
    rng = random.Random(1)

    def entropy(w):
        return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))

    for _ in range(50):
        run = "".join(rng.choice("ab" + "cdefghijklmnop"[: rng.randint(0, 14)]) for _ in range(rng.randint(10, 60)))
        marked = set()
        for i in range(len(run) - 11):
            if entropy(run[i : i + 12]) >= 2.5 + 1e-9:
                marked |= set(range(i, i + 12))
        spans = secrets.high_windows(run, 12, 2.5 + 1e-9)
        assert marked == {i for s, e in spans for i in range(s, e)}
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_entropy_adds_and_the_allow_list_suppresses():
    added = lambda text: [k for k, _, _ in secrets.scan(text)[1] if k.startswith("entropy")]
    assert added(f"key {TOKEN} here") == ["entropy_base64"]
    assert added("DEADBEEF0123456789ABCDEF42") == ["entropy_hex"]
    for harmless in ("incomprehensibilities", "12345678901234567890123", "2024-01-01/2024-12-31", "123e4567-e89b-12d3-a456-426614174000", "example_" + TOKEN, "a" * 30 + "1", "some_module_name_with_parts_12"):
        assert added(harmless) == []
    assert added(f"token={TOKEN}") == []  # a base span already covers it


def test_documents(spark):
    rows = [(1, f"token={TOKEN}"), (1, f"token={TOKEN}"), (2, ""), (3, None), (None, KEY), (4, "é " + DIGEST), (5, "word " * 50_000 + KEY)]
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.scan_documents(table(spark, rows)).collect()}
    assert got == {(1, 1, 0, 0, "assign:0:26"), (2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (None, 0, 1, 0, "access:0:20"), (4, 0, 0, 1, "hex:2:26"), (5, 0, 1, 0, "access:250000:250020")}
    assert secrets.scan_documents(table(spark, [])).count() == 0
    clean = {(r.doc_id, r.text if len(r.text or "") < 50 else None, r.n_chars, r.node) for r in secrets.redact(table(spark, rows)).collect()}
    assert clean == {(1, "[secret]", 8, 8), (2, "", 0, 8), (3, None, None, 8), (None, "[secret]", 8, 8), (4, "é [secret]", 10, 8), (5, None, 250_008, 8)}


def test_random_secrets_are_found_whole():
    rng = random.Random(13)
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for letters in (wide, wide + "+/", "0123456789ABCDEF"):
        for n in (20, 24, 32, 40, 64):
            runs = ["".join(rng.choices(letters, k=n)) for _ in range(500)]
            covered = [sum(e - s for _, s, e in secrets.scan(f"see {run} now")[1]) for run in runs]
            assert set(covered) <= {0, n}
            assert sum(c == n for c in covered) >= (490 if n < 32 else 498)
    assert secrets.scan("key qKzRwLkPxVvWnTtBsYhJmGd here")[1] == [("entropy_base64", 4, 27)]  # no digit
    for harmless in ("getUserFromRequestFactoryList", "/usr/lib/python3/site-packages", "releases/download/v1/package-name-2024-05"):
        assert secrets.scan(harmless)[1] == []


def test_what_other_spans_leave_is_kept():
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYzqkKEY9q3Lm1"
    spans = lambda text: [(k, text[s:e]) for k, s, e in secrets.scan(text)[1]]
    assert spans(f"{KEY}/{key}") == [("access", KEY), ("entropy_base64", "/" + key)]
    assert spans(f"x7Kp2Qz9Lm{DIGEST}zg8Zr2LkP0xW") == [("entropy_base64", "x7Kp2Qz9Lm"), ("hex", DIGEST), ("entropy_base64", "zg8Zr2LkP0xW")]
    assert spans(f"{KEY}/docs/index") == [("access", KEY)]


def test_hex_behind_a_prefix():
    rng = random.Random(12)
    for _ in range(300):
        digits = "".join(rng.choices("0123456789ABCDEF", k=32))
        for prefix in ("id=", "objects/", "build-id_"):
            assert secrets.scan(prefix + digits)[1] == [("entropy_hex", len(prefix), len(prefix) + 32)]


def test_base_spans_that_a_stretch_meets():
    rng = random.Random(9)
    for _ in range(300):
        spans = [("x", s, s + rng.randint(1, 12)) for s in (rng.randint(0, 80) for _ in range(rng.randint(0, 12)))]
        by_end, start = secrets._by_end(spans), rng.randint(0, 80)
        end = start + rng.randint(1, 20)
        first = sum(e <= start for _, _, e in spans)
        assert secrets._touching(by_end, first, start, end) == sorted((s, e) for _, s, e in spans if s < end and start < e)


def test_many_keys_in_one_text_take_linear_time():
    text = " ".join(f"password=hunter{i} {TOKEN}" for i in range(20_000))
    base, spans = secrets.scan(text)
    assert len(base) == 20_000 and len(spans) == 40_000
