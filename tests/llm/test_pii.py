import hashlib
import math
import random
import re
from collections import Counter

from tidewell.llm.pii import pii_clean, pii_spans

#: The base patterns as the contract states them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end(), m.group()) for k, p in BASE.items() for m in re.finditer(p, text) if ok(k, m.group())]


WORD = r"[^\W\d_]{3,}"


def entities(found):
    out = set()
    for k, _, _, v in found:
        v = v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)
        wide = "@" + v.rpartition("@")[2] if k == "email" else v.rpartition(".")[0] + ".*" if k == "ip" else v[:6] + "*"
        out |= {"any", k, f"{k}:{v}", f"{k}:{wide}"}
    return out


def disclosing(texts, alpha):
    """(entity, term) pairs of different texts, and each text's entities."""
    held, words = {}, {}
    for t in texts:
        held[t], masked = entities(base(t)), t
        for p in BASE.values():
            masked = re.sub(p, " ", masked)
        words[t] = {w.lower() for w in re.findall(WORD, masked)}
    n_c, n_t = Counter(c for cs in held.values() for c in cs), Counter(w for ws in words.values() for w in ws)
    n_ct, n = Counter((c, w) for t in texts for c in held[t] for w in words[t]), len(texts)
    return {(c, w) for (c, w), x in n_ct.items() if math.log2(n * x / (n_c[c] * n_t[w])) * x / (x + 1) >= math.log2(n / n_c[c]) / alpha - 1e-9}, held


def brute(rows, alpha=1.4):
    flagged, held = disclosing({t or "" for _, t, *_ in rows}, alpha)
    out = []
    for i, t, *_ in rows:
        b = base(t or "")
        terms = {w for c, w in flagged if c in held[t or ""]}
        extra = [("term", m.start(), m.end()) for m in re.finditer(WORD, t or "") if m.group().lower() in terms and not any(s < m.end() and m.start() < e for _, s, e, _ in b)]
        listed = [f"{k}:{s}:{e}" for k, s, e, _ in b]
        counts = Counter(k for k, *_ in b)
        out.append((i, *(counts[k] for k in BASE), hashlib.sha256(",".join(listed).encode()).hexdigest(), ",".join(listed + [f"{k}:{s}:{e}" for k, s, e in extra])))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, spans int, key int"


def data():
    rng = random.Random(8)
    bits = ["a.b@c.d", "x@y", "a@b.c%d@e.f", "é@x.com", "q@w.com.", "1.2.3.4", "01.002.3.255", "1.2.3.256", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "4111111111111112", "+1 (477) 555-4197", "+12", "+1-", "+44 20 7946 0958 and", "12 34", "+1.2.3.4.5.6.7.8", "plain", "Größe", "\U0001f600", "--", "..", "@", "user%+-._@a-b.c-d.e1"]
    rows = [(i, rng.choice(["", " ", "\n"]).join(rng.choice(bits) for _ in range(rng.randint(0, 12))), 0, 0) for i in range(250)]
    for i in range(6):
        rows.append((1000 + i, f"agent Zebulon writes from boss@hq.example.org number {chr(97 + i) * 4} plain today", 0, 0))
    rows += [(2000, None, 0, 0), (2000, "", 0, 0), (None, "a.b@c.d", 0, 0), (2001, "9" * 30000 + " " + "a" * 30000 + "@" + ".a" * 5000, 0, 0), (2002, "1 " * 15000 + "+" + "1-" * 15000, 0, 0), (1000, rows[250][1], 0, 0)]
    return rows


def test_against_brute_force(spark):
    rows = data()
    got = pii_spans(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(rows)
    assert sorted(map(tuple, got), key=repr) == want
    assert any("term:" in r[-1] for r in want)


def test_clean_text(spark):
    rows = data()
    got = {r.doc_id: r for r in pii_clean(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len({r[0] for r in rows}) and got[2000].text in (None, "")
    assert "Zebulon" not in got[1002].text and "[EMAIL]" in got[1002].text and "cccc" in got[1002].text
    for i, t, *_ in rows[:250]:
        if not base(t):
            assert got[i].text == t
        else:
            assert not any(v in got[i].text for k, _, _, v in base(t) if k == "email")


def test_empty(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert pii_spans(d).count() == 0 and pii_clean(d).count() == 0


def test_whole_table(spark):
    """The registered query on sf0.001 and sf0.01 equals brute force, and terms are found."""
    from tidewell.llm.queries import op8_pii

    for sf in ("sf0.001", "sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
        want = brute(rows)
        assert sorted(map(tuple, op8_pii(spark, f"/root/testdata/{sf}").collect()), key=repr) == want
    assert any("term:" in r[-1] for r in want)
