import hashlib
import random
import re

from tesselon.llm import pii

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and checksum(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def checksum(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_base_spans_equal_plain_regexes():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+- ()5é0\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text)
    assert pii.base_spans("card 4111 1111 1111 1111 ip 10.0.0.255 +1 (743) 555-3824 a.b@c-d.example") == brute("card 4111 1111 1111 1111 ip 10.0.0.255 +1 (743) 555-3824 a.b@c-d.example")


def test_long_runs_are_linear():
    assert pii.base_spans("1" * 300_000) == []
    assert pii.base_spans("a." * 150_000 + "@") == []
    assert pii.base_spans("+1" + " " * 300_000) == []


def test_find_equals_brute_force(documents):
    got = {r["doc_id"]: r for r in pii.find(documents).collect()}
    for r in documents.collect():
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute(r["text"] or ""))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert [got[r["doc_id"]][f"n_{k}"] for k in pii.KINDS] == [spans.count(k) for k in pii.KINDS]
        assert set(filter(None, spans.split(","))) <= set(got[r["doc_id"]]["spans"].split(","))


def with_check_digit(body):
    return next(f"{body}{d}" for d in range(10) if checksum(f"{body}{d}"))


def test_trusted_context_finds_unseen_identifiers(spark):
    cards = [with_check_digit(f"40000000000{i:04d}") for i in range(60)]
    wrong = str(int(cards[0]) + 1)
    rows = [(i, f"please charge account number {c} for this order today") for i, c in enumerate(cards)]
    rows += [(100, f"please charge account number {wrong} for this order today"), (101, f"chapter {wrong} of the book")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[100]["n_card"] == 0 and got[100]["spans"] == "card:29:45" and got[100]["n_found"] == 1
    assert got[0]["spans"] == "card:29:45" and got[0]["n_found"] == 0
    assert got[101]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert masked[100] == masked[0] == "please charge account number <card> for this order today"


def test_awkward_rows(awkward, empty):
    got = pii.find(awkward).collect()
    assert len(got) == awkward.count() and sum(r["n_email"] for r in got) == 1
    assert pii.find(empty).count() == 0
    masked = pii.mask(awkward)
    assert masked.columns == awkward.columns and masked.count() == awkward.count()
    assert masked.filter("text LIKE '%<email>%'").count() == 1 and masked.filter("text IS NULL").count() == 2


def test_trusted_context_finds_shapes_that_no_seed_has(spark):
    phones = [f"+1 ({200 + i}) 555-{1000 + 7 * i}" for i in range(40)]
    mails = [f"user.{i}@mail{i % 9}.example.com" for i in range(40)]
    cards = [with_check_digit(f"40000000000{i:04d}") for i in range(40)]
    frames = {"phone": "you can call me on {} after lunch", "email": "send all letters to {} before noon", "card": "charge account number {} for this"}
    unseen = {
        "phone": ["(743) 555-3824", "743-555-3824", "743 555 3824", "0743/5553824", "743.555.3824"],
        "email": ["john dot doe at mail dot example dot com", "jane (at) example (dot) com", "jim[at]example.com", "joe @ example.com"],
        "card": ["4000 0000 0000 0001", "4000-0000-0000-0003", "4000000000000005"],
    }
    texts = [frames[k].format(x) for k, xs in (("phone", phones), ("email", mails), ("card", cards)) for x in xs]
    asked = [(k, x, frames[k].format(x)) for k, xs in unseen.items() for x in xs]
    other = [f"the chapter {x} is over now" for _, x, _ in asked]
    docs = spark.createDataFrame(list(enumerate(texts + [t for *_, t in asked] + other)), "doc_id int, text string")
    got = [r["spans"] for r in pii.find(docs).orderBy("doc_id").collect()][len(texts) :]
    assert got[: len(asked)] == [f"{k}:{t.index(x)}:{t.index(x) + len(x)}" for k, x, t in asked]
    assert not any(got[len(asked) :])


def test_candidates_are_linear_and_apart():
    for text in ("1 " * 150_000, "(1" * 150_000, "a at " * 60_000, "a." * 150_000 + " at b", "x@" * 150_000, "a at " + "b." * 150_000):
        spans = sorted((a, b) for a, b, *_ in pii.occurrences(text, pii.base_spans(text)))
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    places = lambda text: [text[a:b] for a, b, *_ in pii.occurrences(text, [])]
    assert places("ring (743 555 3824), or 5 4000000000000005 or 1 2") == ["743 555 3824", "5", "4000000000000005", "1", "2"]
    assert places("we meet at noon. Look at 5.30") == ["5.30"]


def brute_scores(edges, rounds=pii.ROUNDS, settled=pii.SETTLED):
    """Confidence and support of each pattern and kind, in plain dictionaries."""
    weight, seeds, total = {}, set(), {}
    for pattern, instance, kind, n in edges:
        weight[pattern, instance] = weight.get((pattern, instance), 0) + n
        total[pattern] = total.get(pattern, 0) + n
        if kind >= 0:
            seeds.add((instance, kind))
    seeded = {i for i, _ in seeds}
    weight = {key: n for key, n in weight.items() if total[key[0]] > 1}
    known, before, z = dict.fromkeys(seeds, 1.0), {}, pii._Z
    for _ in range(rounds):
        hits, support = {}, {}
        for (pattern, instance), n in weight.items():
            for (i, kind), score in known.items():
                if i == instance:
                    hits[pattern, kind] = hits.get((pattern, kind), 0) + n * score
                    support[pattern, kind] = support.get((pattern, kind), 0) + (score == 1.0)
        now = {}
        for key, h in hits.items():
            n = total[key[0]]
            p = h / n
            now[key] = (p + z * z / (2 * n) - z * (max(p * (1 - p), 0) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        if all(abs(c - before.get(key, 0.0)) <= settled for key, c in now.items()):
            break
        votes, every = {}, {}
        for (pattern, instance), n in weight.items():
            every[instance] = every.get(instance, 0) + n
            for kind in range(4):
                if support.get((pattern, kind), 0) > 0:
                    votes[instance, kind] = votes.get((instance, kind), 0) + n * now[pattern, kind]
        known = dict.fromkeys(seeds, 1.0) | {k: v / every[k[0]] for k, v in votes.items() if k[0] not in seeded}
        before = now
    return {key: (c, support[key]) for key, c in now.items()}


def test_graph_scores_equal_brute_force(spark):
    rng = random.Random(4)
    edges = {}
    for _ in range(400):
        instance = rng.randrange(60)
        kind = -1 if instance >= 30 else instance % 4
        edges[f"p{min(rng.randrange(25), rng.randrange(25))}", f"i{instance}", kind] = rng.randrange(1, 4)
    rows = [(*k, n) for k, n in edges.items()]
    got = pii.score_graph(spark.createDataFrame(rows, "pattern string, instance string, kind int, n long")).collect()
    expected = brute_scores(rows)
    assert len(got) == len(expected)
    for r in got:
        confidence, support = expected[r["pattern"], r["kind"]]
        assert abs(r["confidence"] - confidence) < 1e-9 and r["support"] == support


def test_rounds_see_only_what_scores_reach(spark, monkeypatch):
    """Patterns without a seed vote for nothing: instances that are in no other take no part in the rounds."""
    sizes = []
    monkeypatch.setattr(pii, "written", lambda df, instead=None, write=pii.written: sizes.append((df.columns, (out := write(df, instead)).count())) or out)
    rows = [("p", f"seed{i}", 0, 1) for i in range(6)] + [("p", "near", -1, 1), ("q", "near", -1, 1)] + [("q", f"far{i}", -1, 2) for i in range(500)]
    got = {r["pattern"]: r for r in pii.score_graph(spark.createDataFrame(rows, "pattern string, instance string, kind int, n long")).collect()}
    expected = brute_scores(rows)
    assert {(k, 0) for k in got} == set(expected)
    assert all(abs(r["confidence"] - expected[k, 0][0]) < 1e-9 for k, r in got.items())
    assert [n for columns, n in sizes if "all" in columns] == [8]


def test_precision_and_recall_of_planted_identifiers(spark):
    """Identifiers that no fixed pattern matches, among other numbers and names, in seven contexts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    contexts = {
        "phone": ["ring us at {} today", "our desk line is {} or write", "{} is the number to dial"],
        "email": ["write to {} for help", "contact: {} (office)"],
        "card": ["card number {} expires soon", "charged to {} as agreed"],
    }
    seed = {"phone": lambda: f"+1 {digits(3)} {digits(7)}", "email": lambda: f"{word()}@{word()}.com", "card": lambda: with_check_digit("4" + digits(14))}
    unseen = {"phone": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", "email": lambda: f"{word()} at {word()} dot com", "card": lambda: "4" + digits(15)}
    rows, planted = [], set()
    around = lambda: " ".join(word() for _ in range(rng.randint(3, 12)))
    for kind, frames in contexts.items():
        for frame in frames:
            rows += [f"{around()}. {frame.format(seed[kind]())} {around()}" for _ in range(40)]
            for _ in range(15):
                own = unseen[kind]()
                if not pii.base_spans(own):
                    start, end = frame.split("{}")
                    text = f"{around()}. {start}"
                    planted.add((len(rows), kind, len(text), len(text) + len(own)))
                    rows.append(f"{text}{own}{end} {around()}")
    rows += [f"{around()} {rng.choice([digits(16), digits(10), word() + digits(3), '2.0', f'{digits(3)} {digits(4)}'])} {around()}" for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    found = set()
    for r in pii.find(docs).filter("n_found > 0").collect():
        base = {(a, k, b) for a, k, b in pii.base_spans(rows[r["doc_id"]])}
        for span in r["spans"].split(","):
            kind, a, b = span.split(":")
            if (int(a), pii.KINDS.index(kind), int(b)) not in base:
                found.add((r["doc_id"], kind, int(a), int(b)))
    hit = len(found & planted)
    assert len(planted) > 80 and hit >= 0.95 * len(found) and hit >= 0.95 * len(planted), (hit, len(found), len(planted))


def test_local_parts_are_taken_whole_or_not():
    spans = lambda t: [t[a:b] for a, b in pii._spelled(t)]
    assert spans("q" * 80 + " at example dot com") == [] == spans("foo dot " + "q" * 60 + " at example dot com")
    assert spans("see " + "q" * 60 + " at example dot com") == ["q" * 60 + " at example dot com"]
    assert spans("see foo dot bar at example dot com, a at b dot org") == ["foo dot bar at example dot com", "a at b dot org"]


def test_no_round_where_no_pattern_can_be_trusted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"x{chr(97 + i)} some.one{i}@example.com y{chr(97 + i)} {i}0077") for i in range(26)], "doc_id int, text string")
    monkeypatch.setattr(pii, "score_graph", lambda *a: 1 / 0)
    assert {r["n_found"] for r in pii.find(docs).collect()} == {0}


def test_long_context_words_are_told_apart(spark):
    text = lambda c: f"{'x' * 100}{c} 5.5 end of it"
    a, b = (pii.occurrences(text(c), [])[0][4] for c in "ab")
    assert a[0] != b[0] and max(map(len, a + b)) < 120
