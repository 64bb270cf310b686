import hashlib
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import secret_scan as S


def brute_base(text):
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append(("assign", m.start(), m.end()))
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


TOKENS = ["password", "Token", "api_key", "APIKEY", "secret", "ſecret", "toKen", "=", ":", " ", '"', "'", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGHIJKL", "é", "日", "\n", "x", "/", "."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(TOKENS), max_size=25).map("".join))
def test_base_spans(text):
    assert S.base_spans(text) == brute_base(text)


def brute_entropy(run, window, least):
    on = [False] * len(run)
    for i in range(len(run) - window + 1):
        part = run[i : i + window]
        h = -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part))
        if h >= least - 1e-9:
            on[i : i + window] = [True] * window
    return [m.span() for m in re.finditer("1+", "".join("01"[x] for x in on))]


@settings(max_examples=200, deadline=None)
@given(st.text("abcdef0123", max_size=70))
def test_entropy_by_incremental_counts(run):
    assert S.entropy_spans(run, 20, 2.9) == brute_entropy(run, 20, 2.9)


KEYS = ["Zq8LmX2vR7tYb4NcK9wPs3Hd", "k3j9x7q2m5v8b1n6c4z0l7w2", "Q7XK2M9VB4TN8RZ1HW6C", "9f86d081884c7d659a2f", "wJ8rXUtn4FEMI/K7MDENG/bPxRf1CY9zQ3vT"]


def test_method_finds_keys_and_leaves_names_alone():
    for key in KEYS:
        assert [k for k, *_ in S.method_spans(f"use {key} here")] == ["entropy"]
    for plain in ("internationalization_of_everything", "123e4567-e89b-12d3-a456-426614174000", "/usr/local/share/doc/packages", "example-key-1234567890-abcdefghij", "11111111111111111111111111", "thandtiononentwhthtionandmore", "section12paragraph34subsection5", "release-2024-10-12-candidate-3", "x" * 3000, "sample" * 500):
        assert S.method_spans(plain) == [], plain


def test_what_stands_beside_a_key_does_not_hide_it():
    for key in KEYS:
        for before in ("sample=", "123e4567-e89b-12d3-a456-426614174000/", "key0000/", "your-", "example/", "1234567/", "path/to/file/"):
            text = f"see {before}{key}"
            (_, a, b), = S.method_spans(text)
            assert text[a:b].endswith(key[-20:]) and len(text[:a]) >= 4 and key in text[a:b] or key.startswith("wJ8r")


def test_nothing_is_cut_inside_of_a_key():
    for key in ("Zq8LmX21234567cK9wPs3HdT", "k3j9x70000m5v8b1n6c4z0l7", "exampleZq8LmX2vR7tYb4NcK9wPs", "Q7XK2M9VDUMMYTN8RZ1HW6C4", "pQ4xxxxZq8LmX2vR7tYb4NcK9"):
        assert S.method_spans(f"use {key} here") == [("entropy", 4, 4 + len(key))], key
    parts = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4ifQ.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJVadQssw5c"
    assert [parts[a:b] for _, a, b in S.method_spans(parts)] == parts.split(".")
    for plain in ("your-secret-token-1234567890-here", "xxxxxxxxxxxxxxxx-0000000000-key", "example_sample_dummy_12345678", "EXAMPLEKEY-xxxxxxxx-00000000"):
        assert S.method_spans(f"use {plain} here") == [], plain


WINDOWS = (("0123456789abcdefABCDEF", "", 20, 3.0), ("abcdefghijklmnopqrstuvwxyz0123456789", "", 20, 3.6), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "", 20, 3.6), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-", "", 20, 3.9), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-", "eyJ", 20, 3.2))


def brute_pieces(candidate):
    """Assignment signs, UUIDs and placeholders between other signs are taken out, one split after the other."""
    uuid = r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"
    gone = set()
    for m in re.finditer(uuid, candidate):
        gone |= set(range(m.start(), m.end()))
    for m in re.finditer(r"[A-Za-z0-9]+", candidate):
        w = m[0].lower()
        if w in ("example", "sample", "placeholder", "dummy", "changeme", "your") or (len(w) > 3 and set(w) in ({"x"}, {"0"})) or (w.startswith("1234567") and w.isdigit()):
            gone |= set(range(m.start(), m.end()))
    gone |= {i for i, c in enumerate(candidate) if c == "="}
    at = 0
    for i in range(len(candidate) + 1):
        if i == len(candidate) or i in gone:
            yield at, i
            at = i + 1


def brute_allowed(span):
    words = [w for w in re.split(r"[+/_=-]+", span) if w]
    named = re.compile(r"(?:example|sample|placeholder|dummy|changeme|your|key|secret|token|password|x{4,}|0{4,}|1234567[0-9]*)*", re.I)
    if not any(c.isdigit() for c in span) or all(w.isdigit() for w in words) or all(named.fullmatch(w) for w in words):
        return True
    if "+" in span or "=" in span:
        return False
    simple = [bool(re.fullmatch(r"[a-z]+|[A-Z][a-z]*|[0-9]{1,4}", w)) for w in words]
    if all(simple) and any(c in "/_-" for c in span):
        return True
    return bool(re.fullmatch(r"(?:[A-Z]?[a-z]{2,}[0-9]{1,4}[/_-]*)+(?:[A-Z]?[a-z]*)|(?:[A-Z]{3,}[0-9]{1,4}[/_-]*)+[A-Z]*", span))


def brute_runs(piece, letters, start):
    """Longest runs of some letters; with a ``start``, from each place where that stands in what earlier runs leave."""
    i = 0
    while i < len(piece):
        if piece[i] in letters and piece.startswith(start, i):
            j = i
            while j < len(piece) and piece[j] in letters:
                j += 1
            if j > i + len(start):
                yield i, piece[i:j]
            i = max(j, i + 1)
        else:
            i += 1


def brute_method(text):
    """Windows one by one; cuts, classes and allow-list are read a second time, from their description."""
    on = [False] * len(text)
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
        for x, y in brute_pieces(m[0]):
            piece, at = m[0][x:y], m.start() + x
            if brute_allowed(piece):
                continue
            for letters, start, window, least in WINDOWS:
                for begin, run in brute_runs(piece, letters, start):
                    for a, b in brute_entropy(run, window, least):
                        a, b = a + begin, b + begin
                        while a and piece[a - 1] in ALNUM:
                            a -= 1
                        while b < len(piece) and piece[b] in ALNUM:
                            b += 1
                        if not brute_allowed(piece[a:b]):
                            on[at + a : at + b] = [True] * (b - a)
    return on


ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
PARTS = [*KEYS, "/", "=", "-", "_", " ", "sample", "0000", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "1234567", "your", "XXXX", "key", "Example", "word", "Name", "12", "your-", "123e4567-e89b-12d3-a456-426614174000", "f00", "+"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_method_spans_against_single_windows(text):
    on = [False] * len(text)
    for _, a, b in S.method_spans(text):
        on[a:b] = [True] * (b - a)
    assert on == brute_method(text)


def test_spans_that_meet_when_widened():
    text = "Zq8LmX2vR7tYb4NcK9wPs3Hd9f86d081884c7d659a2fwordwJ8rXUtn4FEMI/K7MDENG/bPxRf1CY9zQ3vT"
    assert S.method_spans(text) == [("entropy", 0, len(text))]


def test_long_hostile_runs():
    for run in ("xxxx" * 50_000, "a1" * 100_000, "=" * 200_000, "A" * 200_000, "00001234567" * 20_000, "1234567" * 30_000 + "a1", "xxxx" * 30_000 + "1a", "xxxx0000" * 20_000 + "q", "your_" * 30_000 + "9z", "eyJ1" * 50_000):
        S.method_spans(run)


def test_op4(spark, folder, unique):
    got = {r["doc_id"]: r for r in S.op4_secret_scans(spark, folder).collect()}
    assert len(got) == len(unique)
    for i, text, *_ in unique:
        base = brute_base(text or "")
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))
        on, got_on = brute_method(text or ""), [False] * len(text or "")
        for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s.startswith("entropy")):
            got_on[int(a) : int(b)] = [True] * (int(b) - int(a))
        assert on == got_on
    assert S.op4_secret_scans(spark, f"{folder}/none").count() == 0


def test_redaction(spark, docs, rows, empty):
    out = S.redact_secrets(docs).collect()
    assert len(out) == len(rows) and S.redact_secrets(docs).columns == docs.columns
    by = {r["doc_id"]: r for r in out}
    assert by[80]["text"] is None and by[81]["text"] == ""
    secret = next(r for r in rows if r[1] and "04dbebab" in r[1])
    assert "04dbebab" not in by[secret[0]]["text"] and by[secret[0]]["n_chars"] == len(by[secret[0]]["text"])
    clean = next(r for r in rows if r[0] == 10)
    assert by[10]["text"] == clean[1]
    assert S.redact_secrets(empty).count() == 0
