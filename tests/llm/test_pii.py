import hashlib
import random
import re

from sensorloom.llm.pii import find_personal_data, sanitize

P = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in P.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PARTS = ["a@b.c", "x.y%z@mail-1.example.com", "a@b", "@", "a@b.c%d@e.f", "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "10.0.0.1", "300.1.2.3.4",
         "1.2.3.4.5.6.7.8", "0255.00.1.9", "+1 (017) 555-7713", "+49 30 123456", "+1+22 333 444 555", "é", "😀", "word", " ", " ", "\n", "1", "22-", "--", "12 34 56 78 90 12 3", "...", "0" * 14]


def rows():
    rng = random.Random(7)
    out = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30)))) for i in range(400)]
    out += [(1000, None), (1001, ""), (1002, "1 " * 20000 + "a" * 30000 + "@b" + ".c" * 9000), (1003, "😀 jane@site.org")]
    return out + [out[0]]


def test_base_against_brute_force(docs_of):
    data = rows()
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in find_personal_data(docs_of(data), min_support=10**6).collect())
    want = []
    for i, t in data:
        b = brute(t)
        text = ",".join("%s:%d:%d" % x for x in b)
        want.append((i, *[sum(k == x[0] for x in b) for k in P], hashlib.sha256(text.encode()).hexdigest(), text))
    assert got == sorted(want)
    assert find_personal_data(docs_of([])).count() == 0


def terms_data():
    filler = ["alpha beta gamma delta words here", "other text with alpha and the usual words"]
    data = [(i, "the agent quicksilver wrote jane@site.org the day %d" % i) for i in range(5)]
    return data + [(100 + i, filler[i % 2] + " the %d" % i) for i in range(600)] + [(900 + i, "the ordinary bob%d@site.org wrote the note" % i) for i in range(30)]


def test_terms_that_disclose(docs_of):
    data = terms_data()
    got = {r.doc_id: r for r in find_personal_data(docs_of(data)).collect()}
    text = data[0][1]
    spans = {tuple(x.split(":")) for x in got[0].spans.split(",")}
    named = {text[int(s) : int(e)] for k, s, e in spans if k == "term"}
    assert named == {"quicksilver", "agent", "day"} and ("email", "28", "41") in spans
    assert all(r.n_terms == 0 for i, r in got.items() if i >= 100)


def test_sanitize(docs_of):
    data = terms_data() + [(2000, None), (2001, "a@b.c then 4111 1111 1111 1111 and +4111 1111 1111 11"), (2002, "nothing")]
    out = {r.doc_id: r for r in sanitize(docs_of(data)).collect()}
    assert len(out) == len(data) and out[2000].text is None and out[2002].text == "nothing" and out[2002].label == 7
    assert out[0].text == "the   wrote [EMAIL] the  0"
    assert out[2001].text == "[EMAIL] then [CARD] and [PHONE]"
    assert out[900].text == "the ordinary [EMAIL] wrote the note"
    again = find_personal_data(docs_of([(i, r.text) for i, r in out.items()]))
    assert again.selectExpr("sum(n_email + n_ip + n_card + n_phone)").first()[0] == 0


def test_terms_far_from_entities(docs_of):
    """A disclosing term goes wherever it stands: far from the span, again, and where the entity is not printed."""
    far = "the usual words " * 8
    data = terms_data() + [(50 + i, f"jane@site.org wrote {far}about Moonstone and Quicksilver {i}") for i in range(4)] + [(60, f"the note {far}on quicksilver"), (61, "quicksilverish")]
    out = {r.doc_id: r.text for r in sanitize(docs_of(data)).collect()}
    assert out[50] == f"[EMAIL] wrote {far}  and  0"
    assert out[60] == f"the note {far}on "
    assert out[61] == "quicksilverish"
    spans = {r.doc_id: r for r in find_personal_data(docs_of(data)).collect()}
    assert spans[60].n_terms == 1 and spans[61].n_terms == 0 and spans[50].n_terms >= 2


def test_statistics_against_brute_force(docs_of):
    """Shares and bits of all pairs beyond the thresholds, from counts over distinct texts; copies count once."""
    from math import log2

    from sensorloom.llm.pii import _distinct_texts, _read, disclosing_terms

    rng = random.Random(5)
    vocabulary, people = [f"w{k}" for k in range(60)], [f"p{k}@site.org" for k in range(6)]
    data = []
    for i in range(300):
        who = rng.sample(people, rng.choice([0, 0, 1, 1, 2]))
        words = rng.choices(vocabulary, k=rng.randint(0, 12)) + [f"mark{w[1]}" for w in who if rng.random() < 0.8] + who
        rng.shuffle(words)
        data += [(i, " ".join(words))] * rng.choice([1, 1, 1, 4])
    data += [(900, None), (901, ""), (902, "jane@site.org unique words here")] + [(910 + k, "jane@site.org unique words here") for k in range(9)]
    docs = docs_of(data)
    texts = _distinct_texts(docs, "text")
    word_hash = {r.h: r.w for r in docs.sparkSession.createDataFrame([(w,) for w in [*vocabulary, *(f"mark{k}" for k in range(6))]], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    got = sorted((word_hash.get(r.word), round(r.share, 9), round(r.bits, 9)) for r in disclosing_terms(texts, _read(texts), 3, 0.3, 1.0).collect())
    bags = [(set(re.findall(P["email"].replace("(", "(?:"), t)), set(re.findall(r"\w+", re.sub(r"\S+@\S+", " ", t))), set(re.findall(r"\w+", t))) for t in {t or "" for _, t in data}]
    want = []
    for p in people:
        with_p = sum(p in e for e, _, _ in bags)
        for w in {w for _, free, _ in bags for w in free}:
            both, with_w = sum(p in e and w in free for e, free, _ in bags), sum(w in all_ for _, _, all_ in bags)
            if both >= 3 and both / with_w >= 0.3 and log2(both * len(bags) / (with_w * with_p)) >= 1.0:
                want.append((w, round(both / with_w, 9), round(log2(both * len(bags) / (with_w * with_p)), 9)))
    assert want and got == sorted(want)
    clean = {r.doc_id: r.text for r in sanitize(docs).collect()}
    assert clean[910] == "[EMAIL] unique words here" and clean[900] is None and clean[901] == ""


def test_generalised_terms_and_clashing_names(spark):
    """A term of half the share is replaced by its kind; columns named like the operator's own are kept."""
    data = [(i, "x@y.z saw Falcon 77 k9 reed") for i in range(1)] + [(10 + i, f"x@y.z saw Falcon 77 k9 reed {'a' * i}") for i in range(1, 6)] + [(20 + i, f"Falcon 77 k9 reed {'b' * i}") for i in range(1, 4)]
    data += [(100 + i, f"plain {'c' * (i + 1)} saw") for i in range(400)]
    names = ["text", "spans", "base", "k1", "k2", "times", "row", "terms", "__t", "t"]
    rows = [(i, t, *range(1, len(names))) for i, t in data]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names[1:]))
    out = {r.doc_id: r for r in sanitize(df, min_bits=4.0).collect()}
    assert out[0].text == "[EMAIL] saw [NAME] [NUMBER] [CODE] [WORD]" and out[21].text == "[NAME] [NUMBER] [CODE] [WORD] b"
    assert [out[0][n] for n in names[1:]] == list(range(1, len(names)))
    assert sanitize(df).columns == df.columns
