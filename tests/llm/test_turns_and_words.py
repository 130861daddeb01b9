"""Spelling variants, conversation repair and chat formatting against plain versions, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.llm import chat_format as C
from gridspark.llm import repair as R
from gridspark.llm import spelling as S

TURNS = "conv_id long, turn long, role string, text string"


# --- spelling ---------------------------------------------------------------------------------------------------------

def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_affected_bound_holds():
    """No edit takes more grams than the bound says, whatever is frequent; places move by one behind a gap at most."""
    rng = random.Random(5)
    config = S.SpellingConfig()
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(7, 12)))
        frequent = {"".join(rng.choice("abc") for _ in range(q)) for q in (2, 3, 4) for _ in range(6)}
        frequent = {g for g in frequent if all(g[:k] in frequent for k in range(2, len(g)))}
        tails = {g[k:] for g in frequent for k in range(1, len(g))}
        grams = S.decompose(word, frequent, config)
        assert all(word[a : a + len(g)] == g for a, g in grams) and len({a for a, _ in grams}) == len(grams)
        bound = S.affected(word, grams, frequent, tails, config)
        i = rng.randrange(len(word))
        for other, shift in ((word[:i] + word[i + 1 :], -1), (word[:i] + rng.choice("abcd") + word[i + 1 :], 0), (word[:i] + rng.choice("abcd") + word[i:], 1)):
            theirs = set(S.decompose(other, frequent, config))
            lost = sum((a, g) not in theirs and (a + shift, g) not in theirs for a, g in grams)
            assert lost <= bound, (word, other, grams, theirs)


@pytest.mark.parametrize("frequent", [2, 20, 2000])
def test_near_words_are_all_found(spark, frequent):
    rng = random.Random(frequent)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 11))) for _ in range(60)]
    words = set(base)
    for w in base * 4:
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:]]))
    words = sorted(w for w in words if len(w) >= 7) + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    n = {w: 1 + k % 50 for k, w in enumerate(dict.fromkeys(words))}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = Counter((r["word"], r["other"], r["n"]) for r in S.near_words(df, S.SpellingConfig(frequent=frequent)).collect())
    want = Counter((a, b, n[b]) for a in n for b in n if edit_one(a, b))
    assert got == want


def test_forms_and_roots(spark):
    counts = {"language": 1000, "langage": 100, "langaje": 10, "langajee": 1, "lunguage": 100, "separate": 60, "seperate": 6, "tinyword": 5, "tinywort": 4}
    counts["langajee"] = 2  # not ten times less than langaje
    text = " ".join(w for w, k in counts.items() for _ in range(k)) + " once1234567 singleword"
    # Ids for which the hash damages none of the runs.
    ids = [i for i in range(400) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in [*counts, "singleword"])]
    rows = [(ids[0], text, 1), (ids[1], None, 1), (ids[1], "", 1), (None, "1234 short", 1)]
    out = {r["word"]: r for r in S.group_spellings(spark.createDataFrame(rows, "doc_id long, text string, word int")).collect()}
    assert set(out) == set(counts)
    assert {w: (r["form"], r["root"]) for w, r in out.items() if r["form"]} == {
        "langage": ("language", "language"), "lunguage": ("language", "language"), "langaje": ("langage", "language"), "seperate": ("separate", "separate")}
    assert out["language"]["n_near"] == 2 and out["langage"]["form_n"] == 1000 and out["langajee"]["root"] == "langajee" and out["tinyword"]["n_near"] == 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.group_spellings(none).count() == 0
    with pytest.raises(ValueError):
        S.group_spellings(none, S.SpellingConfig(factor=1))


def test_words_of_damaged_runs(spark):
    text = "Hello-Wörldwide ÀÉÎÕÜabc ßtraßenbahn under_scores " + "x" * 50_000
    rows = [(i, text) for i in range(200)] + [(None, text)]
    got = Counter(r["word"] for r in S.damaged_words(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter()
    for i, t in rows:
        run, runs = "", []
        for c in t + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                runs.append(run.translate({k: k + 32 for k in range(65, 91)}))
                run = ""
        for r in runs:
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            want[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += len(r) >= 7
    assert got == +want


# --- repair -----------------------------------------------------------------------------------------------------------

def cheapest(rows):
    """Every least (cost, audit) by a table over all prefixes, with any number of insertions."""
    reach = {0: (0, "")}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def fill(table):
        for _ in range(3):
            for (x, role), y in step.items():
                if role != "s" and x in table:
                    found = (table[x][0] + 2, table[x][1] + "I")
                    table[y] = min(found, table.get(y, found))
        return table

    for initial, gone, cut in rows:
        table, new = fill(dict(reach)), {}
        for x, (cost, audit) in table.items():
            ways = [(x, 3, "D")]
            if not gone:
                ways += [(step[x, initial], int(cut), "K")] if (x, initial) in step else []
                ways += [(step[x, r], 2 + int(cut), "R") for r in "ua" if (x, r) in step]
            for y, more, letter in ways:
                found = (cost + more, audit + letter)
                new[y] = min(found, new.get(y, found))
        reach = new
    end = fill(dict(reach))
    return min(v for x, v in end.items() if x in (0, 3))


ROW = st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.booleans(), st.booleans())


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=9))
def test_search_proves_the_least_audit(rows):
    assert R.search(rows, R.START, R.goals(R.RepairConfig())) == cheapest(rows)
    bound = R.suffix_bounds(rows, R.RepairConfig())
    for i in range(len(rows)):
        assert bound[i] <= min(f[0] for s in range(4) if (f := R.search(rows[i:], s, R.goals(R.RepairConfig()))))


def test_search_of_long_runs_stays_small():
    rng = random.Random(1)
    for rows in ([("u", False, False)] * 300, [("a", False, True)] * 300, [(rng.choice("suat"), rng.random() < 0.1, rng.random() < 0.3) for _ in range(300)]):
        assert R.search(rows, R.START, R.goals(R.RepairConfig())) == cheapest(rows)


def plain_repair(rows):
    """rows (turn, role, text) in order: the report and the repaired turns."""
    seen, marks, blank, dup, cut = set(), [], 0, 0, 0
    for _, role, text in rows:
        b = not text.strip(" \t\n\x0b\x0c\r")
        d = not b and (role, text) in seen
        seen.add((role, text))
        c = not b and not d and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        blank, dup, cut = blank + b, dup + d, cut + c
        marks.append((role[:1], b or d, c))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = cheapest(marks)
    out, i, state = [], 0, 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        role = rows[i][1] if letter == "K" else "assistant" if state == 2 else "user"
        out.append(f"{role}:{'' if letter == 'I' else rows[i][2]}")
        state = {"s": 1, "u": 2, "a": 3}[role[:1]]
        i += letter != "I"
    illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(marks, marks[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.mark.parametrize("run,parts", [(256, 4), (3, 4), (2, 23)])
def test_repair_against_a_plain_version(spark, run, parts):
    """Also where conversations are cut into short runs and lie in many parts."""
    rng = random.Random(run)
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 5, 9, 30])):
            t = rng.choice([turn, turn, turn, turn + 1, None if turn < 2 else turn])
            rows.append((conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["ok.", "ok.", f"text {turn}", f"fine {turn}!", " \t", ""])))
    rows += [(None, 1, "user", "none."), (None, 2, "assistant", "yes."), (99, None, None, None)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, TURNS).withColumn("run", F.lit("clash"))
        said = R.repaired_digest(df, *R.repair_conversations(df, R.RepairConfig(run=run)))
        got = {r["conv_id"]: tuple(r[c] for c in (*R.COUNTS, "audit", "repaired_sha256")) for r in said.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    mark = {r["text"]: r["h"] for r in df.select(F.coalesce("text", F.lit(" ")).alias("text")).distinct().withColumn("h", F.xxhash64("text")).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, its in by.items():
        its.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], mark[r[2]]))
        assert got[conv] == plain_repair(its), conv
    assert len(got) == len(by)


def test_repaired_turns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "hi."), (1, 1, "user", "what?"), (1, 2, "user", "now?")], TURNS)
    reports, turns = R.repair_conversations(df)
    best = cheapest([("a", False, False), ("u", False, False), ("u", False, False)])
    assert [(r["cost"], r["audit"]) for r in reports.collect()] == [best]
    roles = [r["role"] for r in turns.orderBy("run", "k").collect()]
    assert len(roles) % 2 == 0 and roles == ["user", "assistant"] * (len(roles) // 2)
    none = spark.createDataFrame([], TURNS)
    reports, turns = R.repair_conversations(none)
    assert reports.count() == 0 and turns.count() == 0
    lost = R.repaired_digest(df, *R.repair_conversations(none)).collect()
    assert [(r["conv_id"], r["cost"], r["audit"], r["repaired_sha256"]) for r in lost] == [(1, 0, "", hashlib.sha256(b"").hexdigest())]


# --- chat formatting --------------------------------------------------------------------------------------------------

TEXT = st.lists(st.sampled_from([*"ab\\ <>/s[]INSTURN:é\n", "</s>", "[INST]", "[/INST]", "<s>", " [/INST"]), max_size=30).map("".join)
ROLE = st.sampled_from(["user", "assistant", "system", "tool]", "a\\b", "", "</s>", "[/TURN]"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
def test_format_reads_back(turns):
    assert C.read_turns(C.render(turns)) == turns
    made = C.rendered(turns, [], C.ChatTemplate())
    assert made["piece"] == C.render(turns) and not made["rewritten"]
    for (role, text), s in zip(turns, made["spans"]):
        assert s["role"] == role and C.unescape(made["piece"][s["text_start"] : s["text_end"]]) == text
        assert C.read_turns(made["piece"][s["start"] : s["end"]]) == [(role, text)]
    assert all(C.unescape(C.escape(t)) == t and not any(c in C.escape(t) for c in C.CONTROLS) for _, t in turns)


def closing(turns):
    return "".join(f"<{r}>{t}" for r, t in turns) + "#"


def system_first(turns):
    return "".join(f"<{r}{'' if k else ' first'}{len(turns[:k])}>{t}|" for k, (r, t) in enumerate(turns))


def test_templates_as_black_boxes(spark):
    def forgetful(turns):
        """Drops what assistants said before the last user's turn; made here, so that workers get it by value."""
        last = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=0)
        return "".join(f"<{r}>{t if k >= last or r != 'assistant' else '...'}|" for k, (r, t) in enumerate(turns))

    turns = [("user", "one"), ("assistant", "two"), ("user", "three"), ("assistant", "four")]
    made = C.rendered(turns, [], C.ChatTemplate(closing, None))
    assert not made["rewritten"] and [made["piece"][s["text_start"] : s["text_end"]] for s in made["spans"]] == ["one", "two", "three", "four"] and made["piece"].endswith("#")
    assert C.rendered(turns, [], C.ChatTemplate(forgetful, None))["rewritten"]
    with pytest.raises(ValueError, match="context"):
        C.rendered(turns, [], C.ChatTemplate(system_first, 1))
    with pytest.raises(ValueError, match="bounded context"):
        C.rendered(turns[1:], turns[:1], C.ChatTemplate(closing, 1))
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(2, 0, "user", "x")], TURNS)
    got = {r["conv_id"]: r["rewritten"] for r in C.format_chats(df, C.ChatTemplate(forgetful, None)).collect()}
    assert got == {1: True, 2: False}


@pytest.mark.parametrize("most,parts", [(32, 4), (2, 4), (3, 29)])
def test_chats_over_runs_and_parts(spark, most, parts):
    rng = random.Random(most)
    rows = [(c, k, rng.choice(["user", "assistant", "system"]), rng.choice(["", "</s>", "hello [INST]", "\\n", "é" * 40])) for c in range(30) for k in range(rng.choice([1, 3, 8, 60]))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", None), (77, None, None, "b"), (1, 0, "assistant", "again")]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, TURNS).withColumn("part", F.lit(1))
        got = {r["conv_id"]: r for r in C.chat_digest(C.format_chats(df, most=most)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    by = defaultdict(list)
    for c, k, r, t in rows:
        by[c].append((k is not None, k or 0, r or "", t or ""))
    assert set(got) == set(by)
    for c, its in by.items():
        its = [(r, t) for _, _, r, t in sorted(its, key=lambda x: x[:3])]
        loss = "".join(t for r, t in its if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(its), sha("".join(f"{r}\n{t}\n" for r, t in its)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"], got[c]["formatted_chars"]) == (len(loss), sha(loss), len(C.render(its)))
    assert C.format_chats(df.limit(0)).count() == 0
