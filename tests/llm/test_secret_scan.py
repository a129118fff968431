import hashlib
import random
import re

from gridspark.llm import secret_scan as S

SCHEMA = "doc_id long, text string, key string, kind string, n_chars long"


def base(text):
    assign = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def everything(text, scope=200):
    """All spans, by comparing each weak candidate with every part."""
    strong = [(k, s, e) for s, _, k, e in base(text)]
    flags = re.ASCII
    weak = [("ident", m.start(), m.end()) for m in re.finditer(S.IDENT, text, flags)]
    for m in re.finditer(S.WEAK, text, flags):
        if re.search("[:=]", m[0]) or all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]")):
            weak.append(("weak", *m.span()))
    weak += [("endpoint", m.start(), m.end()) for m in re.finditer(S.ENDPOINT, text, flags)]
    parts, out = strong + weak, list(strong)
    for k, s, e in weak:
        roles = {S.ROLES[o] for o, a, b in parts if a <= e + scope and b >= s - scope}
        if all(r in roles for r in S.NEEDS[k]) and not any(a < e and s < b for _, a, b in strong):
            out.append((k, s, e))
    return sorted(out, key=lambda x: (x[1], list(S.KINDS).index(x[0])))


def make(rng):
    bits = [
        "token = ", "secret: ", 'password="', "api_key=", "PassWd : ", "AKIA" + "Z9" * 8, "AKIAAKIA12", "a1" * 17,
        "deadbeef", "user_name = alice ", "login: bob", "pwd=hunter22x ", "https://db.example.com:5432/x ",
        "h.example.org:99 ", "xY3" * 9, "é ", "💥", "word " * 60, "\n", "abcdefgh", "=", '"', " ",
    ]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))


def test_spans_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "password=token\": abcdefghij", "x" * 100_000 + " token=abcdefgh1 " + "user: root1 " * 40]
    texts += [make(rng) for _ in range(250)]
    texts += texts[10:20]
    docs = spark.createDataFrame([(i, t, "k", "z", 1) for i, t in enumerate(texts)], SCHEMA)
    for r in S.scan(docs).collect():
        text = texts[r.doc_id] or ""
        want = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base(text))
        assert r.base_spans == want, text
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in everything(text)), text
        assert r.n_hex == want.count("hex:") and r.n_assign == want.count("assign:")


def test_weak_parts_count_only_together(spark):
    far = "word " * 80
    rows = [(1, "user = alice pwd = hunter22"), (2, "pwd = hunter22"), (3, f"user = alice {far} pwd = hunter22"), (4, "see https://example.com/a")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.spans for r in S.scan(docs).collect()}
    assert got == {1: "ident:0:12,weak:13:27", 2: "", 3: "", 4: ""}


def test_redaction(spark):
    text = 'é💥 token = "' + "0a" * 20 + '" end'
    rows = [(1, text, "k", "z", 9), (2, "clean", "k", "z", 5), (3, None, None, None, None), (1, text, "k", "z", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.text, r.n_chars) for r in S.redact(docs).collect())
    want = 'é💥 [SECRET]" end'
    assert got == [(1, want, len(want))] * 2 + [(2, "clean", 5), (3, None, None)]
    assert S.redact(docs).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.scan(docs).count() == 0 and S.redact(docs).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_long_dotted_text_and_clashing_names(spark):
    """A megabyte of labels neither overflows a stack nor takes long; columns named like the operator's own keep their values."""
    dotted = "a" + ".a" * 500_000
    text = "user = alice pwd = hunter22"
    docs = spark.createDataFrame([(1, dotted, 5, 6, 7), (2, dotted[:2001] + ":8080 " + text, 5, 6, 7), (3, "a-" * 200_000, 5, 6, 7)], "doc_id long, text string, _text long, _cuts long, d long")
    assert {r.doc_id: r.spans.count("endpoint") for r in S.scan(docs).collect()} == {1: 0, 2: 1, 3: 0}
    got = {r.doc_id: r for r in S.redact(docs).collect()}
    assert all((r._text, r._cuts, r.d) == (5, 6, 7) for r in got.values())
    assert got[1].text == dotted and got[2].text.endswith(" [SECRET] [SECRET]")
