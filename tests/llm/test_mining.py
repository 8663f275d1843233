"""Phrase mining, conversation repair and host rules against brute force, on rows with nulls, repeats, ties and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugemill.llm import collocations, conversations, host_rules, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---- collocations


def mined(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        kept = []
        frequent = {p: a for p, a in counts.items() if a >= support and len(p) > 1}
        for p, a in frequent.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(x) > len(p) and 100 * b >= 80 * a and any(x[i : i + len(p)] == p for i in range(len(x))) for x, b in frequent.items()):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)}
    return out


def sentences(rng, n):
    words = ["the", "The", "of", "élan", "ab\x00c", "x", "y", "Z", "\x85", "naïve", "stone-cold"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None, "und"]), sentences(rng, rng.randrange(0, 60))) for _ in range(60)]
    return [*rows, ("en", None), ("en", ""), ("en", " .,;"), rows[0], rows[0], ("fr", "a b a b a b a b"), ("de", "x y Z " * 4000)]


@pytest.mark.parametrize(("support", "shards", "top"), [(3, 3, 1000), (5, 1, 7)])
def test_collocations(spark, phrases, support, shards, top):
    docs = spark.createDataFrame([(None if i % 7 == 0 else i, text, lang, "w") for i, (lang, text) in enumerate(phrases)], "doc_id long, text string, lang string, words string").withColumn("phrase", F.lit(1))
    got = {tuple(r) for r in collocations.collocations(docs, support, top, shards).collect()}
    assert got == mined(phrases, support, top)


def test_slices_change_no_count():
    rng = random.Random(9)
    for size in (1, 7, 64, 1 << 20):
        texts = [sentences(rng, 200).encode() for _ in range(5)]
        got, want = Counter(), Counter()
        old, collocations.SLICE = collocations.SLICE, size
        known = collocations.Tokens()
        for found, carried in collocations.token_slices(texts):
            for n, at, _ in collocations.Slice(known.ids(found), known, ("en", 1), carried).phrases(lambda h, n: h == h):
                got.update(tuple(found[i : i + n]) for i in at.tolist())
        collocations.SLICE = old
        for text in texts:
            for piece in text.translate(collocations._BYTES).split(b"."):
                words = piece.split()
                want.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
        assert got == want


def test_equal_hashes_are_told_apart():
    ids = collocations.np.array([1, 2, 0, 3, 4, 0, 1, 2])
    at, h = collocations.np.array([0, 3, 6]), collocations.np.array([9, 9, 9], collocations.np.uint64)
    first, count = collocations.same_words(ids, at, h, 2)
    assert dict(zip([tuple(ids[i : i + 2]) for i in first], count, strict=True)) == {(1, 2): 2, (3, 4): 1}


def test_no_phrases(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b a b", "en")], "doc_id long, text string, lang string")).count() == 0


# ---- conversations


def cheapest(rows):
    """Least cost and least letters, by a table over (row, roles so far)."""
    best = {0: (0, "")}

    def inserted(state, cost, letters):
        for _ in range(4):
            yield state, cost, letters
            state, cost, letters = (2, 2, 3, 2)[state], cost + 2, letters + "I"

    for initial, gone, cut in rows:
        new = {}
        for state, (cost, letters) in best.items():
            for q, c, s in inserted(state, cost, letters):
                ways = [(q, c + 3, s + "D")]
                if not gone:
                    kept = q if initial == "" else {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, initial))
                    ways += [((2, 2, 3, 2)[q], c + 2 + cut, s + "R")] + ([(kept, c + cut, s + "K")] if kept is not None else [])
                for to, *way in ways:
                    new[to] = min(new.get(to, (1 << 60, "")), tuple(way))
        best = new
    return min((c, s) for q, (cost, letters) in best.items() for q, c, s in inserted(q, cost, letters) if q in (0, 3))


def repaired(rows):
    """rows of one conversation (turn, role, text) after damage, to the report."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    cost, audit = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)])
    out, i, state = [], 0, 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[i][1:]
        i += letter != "I"
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3, "": state}[role[:1]]
        out.append(f"{role}:{text}")
    turns = [r[0] for r in rows if r[0] is not None]
    count = Counter(faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] += []
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    return out


def talk(rng, n):
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "Cut off", " ", "", "A line.\n", "ünï?", None, "What? "]
    return [(None if rng.random() < 0.05 else rng.randrange(n + 2) if rng.random() < 0.2 else i, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"text {i}.") for i in range(n)]


def test_conversations(spark):
    rng = random.Random(2)
    rows = [(conv, *row) for conv in [*range(250), None] for row in talk(rng, rng.choice([1, 2, 3, 5, 8, 13]))]
    rows += [(1000, *row) for row in talk(rng, 150)] + [(1001, *row) for row in talk(rng, 64)] + [(1002, i, "user", "long. " * 20_000) for i in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("fault", "seen", "there", "copy", "cost")})
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(conversations.damaged(frame)).collect()}
    assert got == {conv: repaired(turns) for conv, turns in damage(rows).items()}
    assert any("R" in r[6] for r in got.values()) and any("I" in r[6] for r in got.values())


def test_sound_conversations_stay(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "U?"), (1, 2, "assistant", "A."), (2, 5, "user", "U."), (2, 7, "assistant", "A.")]
    got = {r["conv_id"]: r for r in conversations.repair(conversations.sound(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (got[1]["cost"], got[1]["audit"], got[2]["gaps"], got[2]["audit"]) == (0, "KKK", 1, "KK")
    assert got[1]["repaired_sha256"] == hashlib.sha256(b"system:S.\nuser:U?\nassistant:A.").hexdigest()
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert conversations.repair(conversations.sound(none)).count() == 0


def test_search_deepens_to_the_least_path():
    rng = random.Random(4)
    for _ in range(400):
        rows = tuple((rng.choice(["u", "a", "s", "t", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(0, 12)))
        cost, letters, _ = conversations.search(rows, 0, conversations.ACCEPTED, True)
        assert (cost, letters) == cheapest(rows)


# ---- the registered queries


@pytest.mark.parametrize("name", ["op11_collocations", "op12_conversations", "op13_host_rules"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    found = con.execute(queries.ORACLE_SQL[name])
    names, rows = [c[0] for c in found.description], df.collect()
    assert sorted(names) == sorted(df.columns) and rows
    assert sorted(str([r[c] for c in names]) for r in rows) == sorted(str(list(r)) for r in found.fetchall())


# ---- host rules


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


@pytest.fixture(scope="module")
def hosts():
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(30))
    rows = [(good(), f"https://www.Site{i % 9}.example/{i}") for i in range(180)]
    rows += [("# few words", "http://bad.example/x") for _ in range(60)] + [(good(), "bad.example"), (good(), "HTTPS://u@BAD.example:80/y"), (good(), "bad.example")]
    rows += [("# few", "one.example"), (None, "site1.example"), ("", None), (good(), None), ("é b c d e f g h i " * 40, "site2.example"), ("same line here\nsame line here\n \n \n" * 9 + good(), "site3.example")]
    rows += [("few", f"https://alone{i}.example") for i in range(3)] + [(good(), f"https://other{i}.example") for i in range(40)]
    return [(i, t, s) for i, (t, s) in enumerate(rows)] + [(0, rows[0][0], rows[0][1])]


def test_host_rules(spark, hosts):
    docs = spark.createDataFrame(hosts, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("host", "n_words", "row", "kept")})
    got = host_rules.verdicts(docs).collect()
    assert len(got) == len(hosts)
    want = {i: counted(t) for i, t, _ in hosts}
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]]
        n, *_, again = want[r["doc_id"]]
        assert r["base_failed"] == (n < 20 or 100 * again > 30 * n)
    # a host that fails as a rule takes its good documents along; one bad document of a small host takes no other
    lost = {i for i, t, s in hosts if "bad.example" in (s or "").lower()}
    assert {r["doc_id"] for r in got if r["host_failed"]} >= lost and not any(r["host_failed"] for r in got if r["doc_id"] < 180)
    assert not any(r["kept"] for r in got if r["doc_id"] in lost) and all(r["kept"] for r in got if r["doc_id"] < 180)
    kept = host_rules.accepted(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    assert all(r["host"] == "x" for r in kept.collect())


def test_shrunk_rates(spark):
    """The prior by moments, in plain arithmetic."""
    groups = {"a": (50, 45), "b": (40, 2), "c": (30, 3), "d": (1, 1), "e": (60, 1)}
    rows = [(h, i < k) for h, (n, k) in groups.items() for i in range(n)]
    got = {r["host"]: r["rate"] for r in host_rules.host_rates(spark.createDataFrame(rows, "host string, bad boolean"), {"rule": lambda: F.col("bad")}).collect()}
    total, failed = sum(n for n, _ in groups.values()), sum(k for _, k in groups.values())
    mean = failed / total
    spread, squares = sum(k * k / n for n, k in groups.values()), sum(n * n for n, _ in groups.values())
    share = ((spread - total * mean**2) / (mean * (1 - mean)) - 4) / (total - squares / total - 4)
    strength = max(1.0, 1 / share - 1)
    for h, (n, k) in groups.items():
        assert got[h] == pytest.approx((k + mean * strength) / (n + strength), abs=1e-6)


def test_host_rules_on_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert host_rules.verdicts(none).count() == 0 and host_rules.accepted(none).count() == 0
