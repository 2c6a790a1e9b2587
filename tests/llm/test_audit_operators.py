"""Personal data, conversation repair and the filter audit, held against plain versions."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

from veilmark.llm import convrepair
from veilmark.llm.convrepair import cheapest, damaged, repair_conversations, repaired_messages, solve_conversations
from veilmark.llm.filteraudit import adjacent_orders, audit_filters
from veilmark.llm.pii import luhn, mask_pii, mod97, personal_data, pii_digest, pii_spans
from veilmark.llm.queries import oracle_sql

# ------------------------------------------------------------------------------------------------------------ personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    """Base spans by the patterns as they are stated."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, *m.span()))
    return out


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d))))
    return total % 10 == 0


PIECES = ["a", "é", "x.y", "@", "b@c.d", "me@host", ".org", "..", "-", "+", "+1 (555) 010-", "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "1.2.3.4", "256.1.1.1", "01.002.3.255", "9" * 20, " ", "\n", "0", "12", ")", "%", "10.0.0.1.10.0.0.2", "+49 30 123456", "𝒳", "tel ", "card "]


def test_base_spans_are_those_of_the_plain_patterns():
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 14)))
        assert [(k, a, b) for k, a, b, _, base in personal_data(text) if base] == plain_base(text), text


def test_added_spans_need_checksum_and_words():
    kinds = lambda text: [k for k, *_ in personal_data(text)]
    assert mod97("GB82 WEST 1234 5698 7654 32") and not mod97("GB82 WEST 1234 5698 7654 33") and luhn("4111111111111111") and not luhn("4111111111111112")
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32.") == ["iban"] and kinds("IBAN GB82 WEST 1234 5698 7654 33.") == []
    assert kinds("ssn 219-09-1234") == ["ssn"] and kinds("part 219-09-1234") == [] and kinds("ssn 666-09-1234") == []
    assert kinds("tel (030) 555-1234") == ["local_phone"] and kinds("set (030) 555-1234") == []
    assert kinds("amex card 378282246310005") == ["short_card"] and kinds("number 378282246310005") == []
    assert kinds("call +1 (555) 010-9999 or 4111 1111 1111 1111") == ["card", "phone"]
    high, low = (next(s for k, *_, s, _ in personal_data(t)) for t in ("server ip 10.0.0.1", "version 10.0.0.1"))
    assert high > 0.6 > low  # the base span stays either way


def test_long_texts_take_linear_time():
    n = 400_000
    for text in ("a" * n, "1" * n, "1." * (n // 2), "1.1.1 " * (n // 6), "+1" + " " * n, "+1 " * (n // 3), "@" * n, "a@b" * (n // 3), "a@b.c" * (n // 5), "1 " * (n // 2), "AB12" * (n // 4), "111-11-" * (n // 7), "(11) " * (n // 5), "." * n, "-1" * (n // 2), "card 4111 1111 1111 1111, " * (n // 26)):
        began = time.time()
        personal_data(text)
        assert time.time() - began < 8, text[:20]


def test_pii_rows(spark):
    rows = [(1, "a@b.cd 1.1.1.1"), (1, "a@b.cd 1.1.1.1"), (None, None), (2, ""), (None, "é +49 30 123456"), (3, "iban GB82 WEST 1234 5698 7654 32")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_email int, spans string")
    got = sorted(map(tuple, pii_digest(docs).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    two = "email:0:6,ip:7:14"
    want = [(1, 1, 1, 0, 0, sha(two), two)] * 2 + [(None, 0, 0, 0, 0, sha(""), ""), (2, 0, 0, 0, 0, sha(""), ""), (None, 0, 0, 0, 1, sha("phone:2:15"), "phone:2:15"), (3, 0, 0, 0, 0, sha(""), "iban:5:32")]
    assert got == sorted(want, key=str)
    assert pii_digest(docs.limit(0)).count() == 0
    masked = {r["doc_id"]: r["masked"] for r in mask_pii(docs.where("text <> ''")).collect()}
    assert masked == {1: "[EMAIL] [IP]", None: "é [PHONE]", 3: "iban [IBAN]"}
    assert pii_spans(docs).schema["spans"].dataType.elementType.names == ["kind", "start", "end", "score", "base"]


# ------------------------------------------------------------------------------------------------------ conversation repair

LEGAL = re.compile("(s?(ua)+)?")


def plain_repair(rows):
    """(cost, audit, messages) of rows (role, text, must, cut) by trying all edits with few insertions."""
    best = None

    def go(i, cost, audit, made, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        initials = "".join(r[:1] or "-" for r, _ in made)
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            return
        if i == len(rows) and LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, made)
        if inserted < len(rows) + 2:
            for role in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*made, (role, "")], inserted + 1)
        if i < len(rows):
            role, text, must, cut = rows[i]
            go(i + 1, cost + 4, audit + "D", made, inserted)
            if not must:
                go(i + 1, cost + 3 * cut, audit + "K", [*made, (role, text)], inserted)
                for to in ("user", "assistant"):
                    go(i + 1, cost + 3 + 3 * cut, audit + "R", [*made, (to, text)], inserted)

    go(0, 0, "", [], 0)
    return best


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", one(text)) if kind == 2 else one(text)
            out += [(conv, turn, "user" if kind == 4 else one(role), text)] * (2 if kind == 3 else 1)
    return out


def plain_conversations(rows, every):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    out = {}
    for conv in every:
        mine = sorted(convs[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:32], hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()))
        seen, faults, marked = set(), Counter(), []
        for _, _, role, text in mine:
            words = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, made = plain_repair(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha)
    return out


def test_cheapest_is_the_plain_one():
    whose = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
    letters = [chr(65 + w * 4 + m * 2 + c) for w in range(4) for m, c in ((0, 0), (0, 1), (1, 0))]
    draw = random.Random(3)
    for _ in range(120):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 4)))
        rows = [(whose["sua-"[(ord(x) - 65) >> 2]], "t", bool((ord(x) - 65) & 2), bool((ord(x) - 65) & 1)) for x in text]
        want = plain_repair(rows)
        assert next(iter(cheapest(text, 0, convrepair.ENDS).values())) == want[:2], text


def _rows(seed, n=40):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Why?  ", "Long " * 20 + ".", " ", "a. "]
    return [(conv, draw.choice([t, t, t, None, 3]), draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "über"]), draw.choice(texts)) for conv in [None, *range(n)] for t in range(draw.randint(1, 4))]


def test_conversations_by_brute_force(spark, monkeypatch):
    rows = _rows(1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, pos int")
    hit = plain_damage(rows)
    assert sorted(map(tuple, damaged(df).collect()), key=str) == sorted(hit, key=str)
    want = plain_conversations(hit, {r[0] for r in rows})
    for bits in (convrepair.BLOCK_BITS, 0):  # blocks of a thousand rows, and of one row each
        monkeypatch.setattr(convrepair, "BLOCK_BITS", bits)
        got = {r["conv_id"]: tuple(r)[1:] for r in repair_conversations(damaged(df), every=df).collect()}
        assert got == want


def test_a_long_conversation_in_blocks(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(7, t, draw.choice(["user", "assistant", "user", "assistant", "system", "tool"]), draw.choice([f"Text {t}.", f"cut {t}", "Again.", ""])) for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = repair_conversations(df).first()
    monkeypatch.setattr(convrepair, "BLOCK_BITS", 4)
    assert repair_conversations(df).first() == whole
    messages = repaired_messages(df, solve_conversations(df)).orderBy("place").collect()
    assert hashlib.sha256("\n".join(f"{m['role']}:{m['text']}" for m in messages).encode()).hexdigest() == whole["repaired_sha256"]
    assert LEGAL.fullmatch("".join(m["role"][0] for m in messages))


def test_conversations_that_are_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_conversations(damaged(df), every=df).count() == 0
    wide = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], df.schema)
    assert repair_conversations(wide).first()["gaps"] == 2**63 - 1


def test_repair_sql(spark):
    """The SQL of the query over the brute-force rows with turns that are all there and none twice."""
    import duckdb

    rows = [(c, n, r, t) for c, group in itertools.groupby(_rows(2), key=lambda r: r[0]) for n, (_, _, r, t) in enumerate(group)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = {r[0]: r[1:] for r in con.execute(oracle_sql()["op12_conversation_repair"]).fetchall()}
    assert got == plain_conversations(plain_damage(rows), {r[0] for r in rows})


# ------------------------------------------------------------------------------------------------------------- filter audit


def test_every_order_once_by_swaps_of_neighbours():
    orders = [tuple(o) for o, _ in adjacent_orders(5)]
    assert sorted(orders) == sorted(itertools.permutations(range(5)))
    for a, b in zip(orders, orders[1:]):
        moved = [i for i in range(5) if a[i] != b[i]]
        assert len(moved) == 2 and moved[1] == moved[0] + 1


def plain_audit(docs, labels):
    fails = {}
    for n, (doc, text, lang) in enumerate(docs):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mask = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        mask["E"] = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs)
        has = lambda i: doc is not None and any(x[0] == doc and x[i] == 1 for x in labels)
        fails[n] = (lang or "", {f for f, bad in mask.items() if bad}, has(1), has(2))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails.values()}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [x for x in fails.values() if x[0] == part]
            everyone = list(left)
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in everyone) - len(gone)
                shapley[part, f] += len(gone)
                out[part, order, i + 1] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in everyone), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_brute_force(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcXYZ#é𝒳") for _ in range(draw.randint(1, 6)))
    texts = [None, "", "short", "SHOUT " * 120, " ".join(f"w{i}" for i in range(150)), " ".join(f"w{i}" for i in range(150)) + " $", "  \x85 a", "x " * 60_000, *(" ".join(word() for _ in range(draw.choice([20, 120]))) for _ in range(12))]
    docs = [(draw.choice([None, *range(60)]), draw.choice(texts), draw.choice(["en", "de", None, ""])) for _ in range(120)]
    labels = [(draw.choice([None, *range(40)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(80)]
    df = spark.createDataFrame([(*d, "e", 1) for d in docs], "doc_id long, text string, lang string, part string, n int")
    said = spark.createDataFrame([(*x, "?") for x in labels], "doc_id long, quality int, toxic int, good string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit_filters(df, said).collect()}
    assert got == plain_audit(docs, labels)
    assert audit_filters(df.limit(0), said).count() == 0
    none = audit_filters(df.where("text is null"), said.limit(0)).where("removed > 0 and good_lost + toxic_lost > 0")
    assert none.count() == 0


def test_audit_sql(spark):
    import duckdb

    docs = [(i, ["a b", "B " * 110, "c %", None][i % 4], ["en", None][i % 2]) for i in range(1, 30)]
    labels = [(i, i % 2, i % 3) for i in range(0, 20)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    got = {r[:3]: r[3:] for r in con.execute("SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM (" + oracle_sql()["op13_filter_audit"] + ")").fetchall()}
    assert got == plain_audit(docs, labels)
