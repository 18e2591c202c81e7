"""Packing, urls, personal data, secrets, chats, toxicity and decontamination."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import decontaminate, pii, secrets, toxicity, url_filter
from corpusloom.llm.chat_collapse import collapsed
from corpusloom.llm.packing import Encoder, pack, pack_histogram
from corpusloom.llm.queries import RULES
from corpusloom.llm.url_filter import Rule, judged

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, spans string, length long, score double"


def table(spark, rows):
    """Documents with null in every other column and columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "x", 1, 0.5) for i, t in rows], DOCS)


# packing


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", " ", "\x1c", "\x00", "1", "'s", "!", ".", ",", "<|endoftext|>", "word", "日本", " ", "\r\n", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_encoder_gives_the_tokenizer_ids():
    plain = Tokenizer.from_file(VOCABULARY)
    texts = odd_texts(4000, 1) + ["Some words, and more.\nAnother line: with  two spaces.\n\n\nEnd. " * 20]
    encoder = Encoder(VOCABULARY)
    for start in range(0, len(texts), 500):
        some = texts[start : start + 500]
        want = [np.asarray(e.ids, "<u4").tobytes() for e in plain.encode_batch(some, add_special_tokens=False)]
        assert encoder.encode(some) == want


@pytest.mark.parametrize("seed", range(4))
def test_pack_histogram(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 65): rng.choice([1, 2, 7, 1000]) for _ in range(rng.randrange(1, 40))}
    patterns = pack_histogram(counts, 64)
    got = Counter()
    for p in patterns:
        assert 0 < sum(size * copies for size, copies in p.parts) <= 64 and p.count > 0
        for size, copies in p.parts:
            got[size] += copies * p.count
    assert got == Counter(counts)
    total = sum(size * n for size, n in counts.items())
    assert sum(p.count for p in patterns) <= max(sum(n for s, n in counts.items() if s > 32), 2 * math.ceil(total / 64))
    assert pack_histogram({}) == []


@pytest.mark.parametrize("payload", ["ids", "ids_crc32"])
def test_pack(spark, payload):
    rows = list(enumerate(odd_texts(60, 2))) + [(60, "word " * 500), (61, None), (62, ""), (None, "x y"), (5, "again"), (5, "again")]
    got = pack(table(spark, rows).repartition(3), VOCABULARY, 64, payload=payload).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(sequences) <= math.ceil(total / 64) + 2
    plain = Tokenizer.from_file(VOCABULARY)
    pieces = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 64):
            piece = ids[a : a + 64]
            value = tuple(piece) if payload == "ids" else zlib.crc32(np.asarray(piece, "<u4").tobytes())
            pieces[i, a, len(piece), len(ids), value] += 1
    assert pieces == Counter((r.doc_id, r.start, r.length, r.doc_tokens, tuple(r[payload]) if payload == "ids" else r[payload]) for r in got)
    assert pack(table(spark, []), VOCABULARY).count() == 0


# urls


def test_rules_and_aliases(spark):
    link = '<LINK href="{}" rel=canonical>'
    refresh = "<meta http-equiv='refresh' content='0; URL={}'>"
    rows = [
        (1, "http://a.example.com/en/1", None), (2, "https://WWW.example.com/en/2?q#f", ""), (3, "http://x.net/es/1", "<p>"),
        (4, "http://free.org/1", link.format("http://x.net/es/1")), (5, "http://free.org/2", refresh.format("/1")),
        (6, "https://free.org/2#part", None), (7, "http://ok.com/", link.format("http://free.org/2")), (8, "no scheme", link.format("http://x.net/es/1")),
        (9, None, None), (10, "http://notexample.com/en/", None), (11, "http://x.org", None), (12, "http://com/", None), (13, "http://m.net/esx", None),
        (1, "http://free.org/3", link.format("http://blocked.net/fr/9")), (None, "://y.net/fr/", None),
    ]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judged(pages, RULES).collect())
    assert got == Counter([
        (1, "a.example.com", "/en/1", "example.com/en/", "block"), (2, "www.example.com", "/en/2", "www.example.com/en/", "allow"),
        (3, "x.net", "/es/1", "net/es/", "block"), (4, "free.org", "/1", None, "block"), (5, "free.org", "/2", None, "block"),
        (6, "free.org", "/2", None, "block"), (7, "ok.com", "/", "com/", "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"),
        (10, "notexample.com", "/en/", "com/", "allow"), (11, "x.org", "", None, "allow"), (12, "com", "/", "com/", "allow"),
        (13, "m.net", "/esx", None, "allow"), (1, "free.org", "/3", None, "block"), (None, "y.net", "/fr/", "net/fr/", "block"),
    ])
    assert judged(pages.limit(0), RULES).count() == 0
    assert judged(pages.filter("page_id = 11"), [Rule("block", "org", "")]).first().verdict == "block"
    assert url_filter.URL.startswith("(?s)")


LINKS = [
    # page, html, address that it is tied to
    ("http://p.org/a/b/c?x=1", '<link rel="canonical" href="//X.net/es/1">', "x.net/es/1"),
    ("http://p.org/a/b/c", "<meta http-equiv=refresh content='0;url=es/1'>", "p.org/a/b/es/1"),
    ("http://p.org/a/b/c", '<link rel="alternate canonical" href=/es/1>', "p.org/es/1"),
    ("http://p.org/a/b/c", '<link rel=canonical href="/one"><link rel="Canonical" href="/two">', "p.org/two"),
    ("http://p.org/a/b/c", '<META HTTP-EQUIV=Refresh CONTENT="5"><meta http-equiv="refresh" content="5; URL=\'../up?a=1&amp;b=2\'">', "p.org/a/up?a=1&b=2"),
    ("http://p.org/a/b/c", '<link title="a > b" href="?id=2" rel=canonical>', "p.org/a/b/c?id=2"),
    ("http://p.org/a/b/c", '<link href="./../../../z/./y/.." rel=canonical>', "p.org/z/"),
    ("http://p.org", '<link href="n.html" rel=canonical>', "p.org/n.html"),
    ("http://p.org/q?old=1", '<link href=" https://e.org#part " rel=canonical>', "e.org/"),
    ("http://p.org/q?old=1", '<link rel=canonical href="#top">', "p.org/q?old=1"),
]
NO_LINKS = [
    '<link rel="canonical" href="">', '<link rel=canonical href="mailto:a@b.c">', '<link rel=noncanonical href="/x">', '<link data-href="/x" rel="canonical">',
    '<meta name=refresh content="0;url=/x">', '<a rel="canonical" href="/x">', "<link rel=canonical", '<links rel=canonical href="/x">',
]


def test_every_form_of_link(spark):
    rows = [(i, u, h, None) for i, (u, h, _) in enumerate(LINKS)] + [(100 + i, "http://p.org/n", h, None) for i, h in enumerate(NO_LINKS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, target string")
    found = {tuple(r) for r in url_filter.links(pages).collect()}
    for u, _, to in LINKS:
        assert any(t == to for _, t in found), to
    assert len(found) == len(LINKS) + 1 and not any(f == "p.org/n" for f, _ in found)


def test_blocked_targets_of_every_form_equal_the_sql(spark):
    """The same rows through the query and its SQL; targets are blocked by host or by path."""
    import duckdb

    from corpusloom.llm import sqltext

    rows = [(i, u.replace("p.org", f"p{i}.org"), h) for i, (u, h, _) in enumerate(LINKS)]
    rows += [(50 + i, f"http://p{i}.org/x", f'<link rel=canonical href="{u}">') for i, (u, _, _) in enumerate(LINKS)]
    forms = ["//b.net/es/1", "http://b.net/es/1#f", "/../es/../es/1", "es/1", "../es/1", "/fr/1?a&amp;b", "?q", "&#38;", "/x/./y"]
    for i, form in enumerate(forms):
        rows.append((100 + i, "http://s.net/es2/x", f"<p><link rel='x canonical' href='{form}'>"))
        rows.append((200 + i, f"http://f{i}.org/es/x/y", f"<meta http-equiv='refresh' content='1;url={form}'><link rel=canonical href=http://s.net/es2/x>"))
        rows.append((300 + i, f"http://f{i}.org/es/1", None))
    rows += [(400 + i, "http://p.org/n", h) for i, h in enumerate(NO_LINKS)] + [(500, None, "<link rel=canonical href=/x>"), (501, "x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, judged(pages, RULES).collect()), key=repr)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(con.execute(sqltext.URL_FILTER).fetchall(), key=repr)
    assert [tuple(r) for r in got] == want
    verdicts = {r[0]: r[4] for r in got}
    assert verdicts[0] == "block" and verdicts[100] == verdicts[101] == verdicts[200] == "block" and verdicts[400] == "allow"


# personal data and secrets


def luhn(digits):
    return sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_data(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, valid in kinds for m in re.finditer(p, text) if valid(m.group())]


def test_personal_data(spark):
    rng = random.Random(6)
    parts = ["a", "b.c", "@", ".", "-", " ", "1", "25", "255.1", "0.0.0.0", "+4", "(1)", "4111 1111 1111 1111", "%", "é😀", "x@y.zz", "00000255", "+49 30 1234567", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))) for i in range(300)]
    rows += [(9000, None), (9001, ""), (9002, "a" * 2000), (9003, "1 " * 100_000), (9004, "1." * 3000), (9005, "x@y.zz 1.2.3.4 " * 3000),
             (9006, "+" + "(" * 5000), (None, "q@r.st"), (9007, "a@" * 5000)]
    got = pii.personal_data(table(spark, rows).repartition(4)).collect()
    base = {k.name for k in pii.KINDS if k.base}
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in base] for r in got}
    assert found == {i: base_data(t or "") for i, t in rows}
    # too long for the plain patterns, which try every start of a run
    long = [(1, "a" * 300_000), (2, "1." * 60_000), (3, "7" * 300_000)]
    got = {r.doc_id: len(r.spans) for r in pii.personal_data(table(spark, long)).collect()}
    assert got == {1: 0, 2: 15_000, 3: 0}
    assert pii.personal_data(table(spark, [])).count() == 0


def test_validators_and_context(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "DE89 3704 0044 0532 0130 01"), (3, "GB82WEST12345698765432, bank account GB82WEST12345698765433"),
            (4, "078-05-1120"), (5, "social security 078-05-1120"), (6, "security 000-05-1120"), (7, "mail é q@r.st")]
    got = {r.doc_id: [(s.kind, s.start, s.end, s.score) for s in r.spans] for r in pii.personal_data(table(spark, rows)).collect()}
    assert got == {1: [("iban", 5, 32, 1.0)], 2: [], 3: [("iban", 0, 22, 0.7)], 4: [], 5: [("ssn", 16, 27, 0.6)], 6: [], 7: [("email", 7, 13, 1.0)]}


def test_account_numbers_by_country(spark):
    de, gb = "DE89370400440532013000", "GB82WEST12345698765432"
    spaced = "DE89 3704 0044 0532 0130 00"
    texts = [
        f"IBAN: {de} BIC: COBADEFF", f"{de} EUR 50", f"{spaced} BIC COBADEFFXXX", f"{spaced} 2024", f"{de} {gb}", f"{spaced} {spaced}",
        f"BE16 {spaced}", f"x{de}", f"{de}X", f"{de[:-1]}", "NO9386011117947 A1", "MT84MALT011000012345MTLCAST001S 2024",
    ]
    want = [
        [(6, 28)], [(0, 22)], [(0, 27)], [(0, 27)], [(0, 22), (23, 45)], [(0, 27), (28, 55)],
        [(5, 32)], [], [], [], [(0, 15)], [(0, 31)],
    ]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in pii.personal_data(table(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(want))
    assert len(set(pii.LISTED.split("|"))) == len(pii.LISTED.split("|"))


def test_context_of_lists_and_after(spark):
    numbers = [f"{100 + i}-45-6789" for i in range(40)]
    texts = [
        "SSN: 123-45-6789, 234-56-7891", "Social security\n" + "\n".join(numbers), "123-45-6789 (SSN)", ", ".join(numbers) + " (SSN)",
        "ssn é😀 123-45-6789 und 234-56-7891", "ssn " + "x" * 40 + " 123-45-6789", "123-45-6789 " + "x" * 40 + " ssn", "é😀" * 300 + " tax 123-45-6789",
        "123-45-6789, no. 234-56-7891", "123-45-6789, SSN of A; 234-56-7891, SSN of B", "part 123-45-6789. SSN 234-56-7891",
        "IBAN BE16 DE89 3704 0044 0532 0130 00, GB82WEST12345698765432", "SSN 000-45-6789, 234-56-7891",
    ]
    want = [2, 40, 1, 40, 2, 0, 0, 1, 0, 2, 1, 2, 1]
    rows = {r.doc_id: r.spans for r in pii.personal_data(table(spark, list(enumerate(texts)))).collect()}
    assert {i: len(s) for i, s in rows.items()} == dict(enumerate(want))
    assert {s.score for i, s in [(i, s) for i in rows for s in rows[i]] if i != 11} == {0.6} and {s.score for s in rows[11]} == {1.0}


def base_secrets(text):
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), k, m.end()) for k, (_, p, valid) in enumerate(kinds) for m in re.finditer(p, text, re.A) if valid(m)]
    return [(kinds[k][0], a, b) for a, k, b in sorted(found)]


@pytest.mark.parametrize("alphabet", ["hex", "HEX", "lower", "upper", "base32", "letters", "letters and digits", "base64", "base64url"])
def test_random_keys_are_found(alphabet):
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    of = {"hex": digits + "abcdef", "HEX": digits + "ABCDEF", "lower": low + digits, "upper": low.upper() + digits, "base32": low.upper() + "234567",
          "letters": low + low.upper(), "letters and digits": low + low.upper() + digits}
    chars = of.get(alphabet) or of["letters and digits"] + {"base64": "+/", "base64url": "-_"}[alphabet]
    rng = random.Random(8)
    for size, least in ((20, 0.95), (24, 0.98), (32, 0.99), (40, 0.995)):
        assert sum(secrets.suspicious("".join(rng.choice(chars) for _ in range(size))) for _ in range(1000)) >= 1000 * least


def test_allowed_parts_hide_no_key():
    key = "q7ZpTx2LmV9aKc4RfWb8"
    for run in (key, f"2024-03-01_{key}", f"{key}_2024-03-01", f"{key}0123456789", f"abcdefghijklmnopqrstuvwxyz{key}", f"2024-03-01-{key}-0123456789"):
        assert secrets.suspicious(run)
    for run in ("2024-03-01_0123456789", "2024-03-01/2024-03-02/2024-03-03", "0123456789abcdefghijklmnopqrstuvwxyz", "some/path/with-many-words/and/2024",
                "getUserAccountInformation", "parseHTTPResponseHeaders", "DONAUDAMPFSCHIFFFAHRT", "550e8400-e29b-41d4-a716-446655440000", "=" * 60, "12345678901234567890123",
                "sha256_digest_of_all_v2_keys", "2024-03-01_report-of-the-year"):
        assert not secrets.suspicious(run)
    assert [(a, b) for a, k, b in secrets.secrets(f"x 2024-03-01_{key} y") if k == 3] == [(2, 33)]


def test_parts_beside_a_date_are_no_neighbours():
    assert not secrets.suspicious("abcQ7zp1Xk2024-03-01Lm9RtW4bYc")
    assert secrets.suspicious("abc2024-03-01q7Zp9XbT2mLk8RvY4sWd6Hc1")


def test_a_run_inside_a_base_span_is_reported_once():
    key = "9f86d081884c7d659a2feaa0c55ad015"
    assert secrets.secrets(f"see {key} ok") == [(4, 2, 36)]
    assert secrets.secrets("password=q7Zp9XbT2mLk8RvY4sWd6Hc1") == [(0, 0, 33)]
    longer = f"{key}-Qz8LmXvT2rKw7YpB4nHs"
    assert secrets.secrets(longer) == [(0, 2, 32), (0, 3, 53)]


def test_names_are_no_secrets():
    """Precision on made names of code; of random keys at least 98 % are still found."""
    rng = random.Random(21)
    words = "user config http server index buffer handler Manager Factory total width matrix node cache REQUEST MAX Element page".split()
    terms = "i18n l10n k8s a11y utf8 b64 x86 sha256 3DES AES128GCM v1beta2 h264 md5 ipv6 s3 ec2 p99 mp4".split()
    names = []
    while len(names) < 2000:
        name = rng.choice("_-/")
        name = name.join(rng.choice(words + terms if name == "_" else words) for _ in range(rng.randrange(3, 9)))
        names += [name] if len(name) >= 20 else []
    assert sum(map(secrets.suspicious, names)) <= 0.01 * len(names)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
    keys = ["".join(rng.choice(chars) for _ in range(32)) for _ in range(2000)]
    assert sum(map(secrets.suspicious, keys)) >= 0.98 * len(keys)


def test_secrets(spark):
    rng = random.Random(7)
    parts = ["password", "PassWd", "api_key", "APIKEY", "ſecret", "Token", '"', "'", ":", "=", " ", "AKIA", "ABCDEFGH12345678", "0a1b2c3d4e5f", "deadbeef", "xyz", "é", "x.y", "q7Zp+/"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))) for i in range(1500)]
    rows += [(9000, None), (9001, ""), (9002, "f" * 200_000), (9003, "token" + " " * 50_000 + ":" + "a" * 9), (None, "AKIA" * 5), (9004, "Ab1" * 60_000)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(table(spark, rows).repartition(4)).collect()}
    assert {i: [s for s in x if s[0] != "entropy"] for i, x in got.items()} == {i: base_secrets(t or "") for i, t in rows}
    assert secrets.scan(table(spark, [])).count() == 0


def test_entropy():
    rng = random.Random(8)
    for _ in range(200):
        run = "".join(rng.choice("abcdEF12") for _ in range(rng.randrange(1, 60)))
        size = min(20, len(run))
        windows = [run[i : i + size] for i in range(len(run) - size + 1)]
        want = max(-sum(n / size * math.log2(n / size) for n in Counter(w).values()) for w in windows)
        assert abs(secrets.entropy(run) - want) < 1e-9
    assert secrets.suspicious("q7Zp9XbT2mLk8RvY4sWd6Hc1")
    for plain in ("550e8400-e29b-41d4-a716-446655440000", "some-words-in-a-long-slug", "a" * 40, "Donaudampfschifffahrtsgesellschaft", "12345678901234567890123", "abcdefghijklmnopqrstuvwxyz0"):
        assert not secrets.suspicious(plain)


# chats


def brute_collapse(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            key = lambda v: (v is not None, v if v is not None else 0)
            convs.setdefault(c, []).append((key(turn), (role is not None, role or ""), (text is not None, text or "")))
    seqs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    return {c for c, s in seqs.items() if not any(o[: len(s)] == s and (len(o) > len(s) or d < c) for d, o in seqs.items() if d != c)}


def test_collapse(spark):
    rng = random.Random(9)
    rows = []
    for c in range(80):
        for turn in range(rng.randrange(1, 6)):
            rows.append((c, turn + (c % 2), rng.choice(["user", "assistant"]), rng.choice(["a", "b", None])))
    long = [(200, t, "user", str(t)) for t in range(3000)]
    rows += long + [(201, t, r, x) for _, t, r, x in long[:2500]] + [(202, t, r, x) for _, t, r, x in long] + rows[:9]
    rows += [(None, 0, "user", "a"), (300, None, None, None), (301, 5, "", ""), (302, 0, None, None), (302, 1, "user", "z")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, position string")
    got = collapsed(df.repartition(6)).collect()
    assert {r.conv_id for r in got} == brute_collapse(rows)
    mine = sorted((r.position, r.rendered) for r in got if r.conv_id == 200)
    assert mine == [(t + 1, f"<|im_start|>user\n{t}<|im_end|>\n") for t in range(3000)]
    assert all(r.n_turns == 3000 for r in got if r.conv_id == 200)
    assert collapsed(df.limit(0)).count() == 0


# toxicity


def test_learns_from_positive_and_unlabelled(spark):
    rng = random.Random(10)
    words = [f"{a}{b}{c}" for a in "bcdfgk" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "zzrot", "quxon"]))
        rows.append((i, " ".join(text)))
        if rng.random() < 0.5:
            labels.append((i, int(bad)))
    truth = {i: any(w in t.split() for w in ("vile", "zzrot", "quxon")) for i, t in rows}
    rows += [(5000, None), (5001, ""), (None, "vile"), (5002, "bal " * 100_000)]
    docs = table(spark, rows)
    marks = spark.createDataFrame(labels + [(labels[0][0], 1 - labels[0][1]), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    assert len(got) == len(rows)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert not got[None].held_out and not got[5001].predicted
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    # labels of the held-out fold change nothing
    other = toxicity.train(docs, marks.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(model.weights, other.weights)
    none = toxicity.train(docs, marks.limit(0))
    assert toxicity.scores(docs, none).filter("predicted = 1").count() == 0
    assert toxicity.scores(docs.limit(0), model).count() == 0


def test_risk_is_kept_from_going_negative():
    positive = [np.asarray([1]) for _ in range(30)]
    unlabelled = [np.asarray([1]) if i % 5 == 0 else np.asarray([2]) for i in range(200)]
    model = toxicity.fit(positive, unlabelled, 0.2)
    score = lambda f: 1 / (1 + np.exp(-(model.weights[f] + model.bias)))
    assert score(1) > 0.8 and score(2) < 0.3


# decontamination


def plain_distance(item, text):
    row = list(range(len(item) + 1))
    for w in text:
        new = [0]
        for j, x in enumerate(item, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
        yield row[-1]


def test_bit_parallel_distance():
    rng = random.Random(11)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 70))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 60))]
        assert list(decontaminate.distances(item, text)) == list(plain_distance(item, text))


def edited(rng, words, item, edits):
    part = list(item)
    for _ in range(edits):
        at, kind = rng.randrange(len(part)), rng.randrange(3)
        part[at : at + (kind < 2)] = [rng.choice(words)] * (1 + (kind == 2)) if kind else []
        part = part or ["z"]
    return part


@pytest.mark.parametrize("size", [5, 12, 30, 60, 100, 200, 400])
def test_embedding_alone_finds_edited_items(size):
    """Recall of the sampled walks without seeds, all edits used, and what they let through
    of unrelated text whose words are as frequent as a language's."""
    rng = random.Random(size)
    words = [f"w{i}" for i in range(5000)]
    weights = [1 / (i + 2.7) for i in range(5000)]
    items = [rng.choices(words, weights, k=size) for _ in range(60)]
    found = decontaminate.Finder([(i, " ".join(t)) for i, t in enumerate(items)])
    around = lambda: rng.choices(words, weights, k=size)
    near = [" ".join(around() + edited(rng, words, t, size // 5) + around()) for t in items]
    far = [" ".join(around() + around() + around()) for _ in items]
    at = [[i, 0, i] for i in range(60)]
    for texts, low, high in ((near, 0.95, 1), (far, 0, 0.15)):
        w = decontaminate.Words([t.encode() for t in texts])
        windows = np.asarray([[d, w.first[d] + size, i] for d, _, i in at], np.int64)
        assert low <= found.agrees(w, windows).mean() <= high


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(15)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=20))) for i in range(30)]
    docs = table(spark, [(i, " ".join(rng.choices(words, k=30)) + " " + items[i % 30][1] * (i % 2)) for i in range(90)])
    benchmark = spark.createDataFrame(items + items[:3], "item_id long, text string")
    whole = sorted(decontaminate.benchmark_passages(docs, benchmark).collect())
    monkeypatch.setattr(decontaminate, "BYTES", 600)
    assert len(whole) == 45 and sorted(decontaminate.benchmark_passages(docs, benchmark).collect()) == whole
    assert decontaminate.without_benchmark(docs, benchmark).count() == 45


def test_benchmark_passages(spark):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "abcdefgh" for b in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    items += [(100, None), (101, " ,. "), (102, items[0][1])]
    rows = []
    for i in range(300):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 80))]
        if i % 3 == 0:
            part = rng.choice(items[:40])[1].split()
            for _ in range(rng.randrange(0, len(part) // 4 + 1)):
                at, kind = rng.randrange(len(part)), rng.randrange(3)
                part[at : at + (kind < 2)] = [rng.choice(words)] if kind else []
                part = part or ["z"]
            cut = rng.randrange(len(w) + 1)
            w = w[:cut] + [x.upper() + rng.choice([",", "", "."]) for x in part] + w[cut:]
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    rows += [(900, None), (901, ""), (None, items[3][1])]
    want = set()
    for i, t in rows:
        text = decontaminate.normal(t or "").split()
        for item_id, q in items:
            item = decontaminate.normal(q or "").split()
            if item and min(plain_distance(item, text), default=99) <= int(decontaminate.SHARE * len(item)):
                want.add((i, item_id))
    benchmark = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_passages(table(spark, rows).repartition(4), benchmark).collect()}
    assert got <= want and len(want) > 80
    assert len(got) >= 0.99 * len(want)
    kept = [r.doc_id for r in decontaminate.without_benchmark(table(spark, rows), benchmark).collect()]
    assert sorted(kept) == sorted(i for i, _ in rows if i not in {g[0] for g in got})
    assert decontaminate.benchmark_passages(table(spark, rows), benchmark.limit(0)).count() == 0
    assert decontaminate.without_benchmark(table(spark, []), benchmark).count() == 0


def test_both_libraries_give_the_same_ids():
    from tokenizers import Tokenizer

    encoder, plain = Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    assert encoder.quick is not None
    rng = random.Random(11)
    letters = "aaabcdeE  \n\t\r.,!?'sletvm019é  ́日\U0001f600\x1c\x00‍-_#"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["", "<|endoftext|>", "a <|endoftext|> b", "x" * 5000, " \n \n  x", "it's we'll  I'M"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
