"""Token alignment, filter audit and chat formatting against plain code, and on odd tables."""

import hashlib
import itertools
import json
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionlake.llm import align, audit, chat
from tests.llm import cases

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(rows):
    """The contract, by the tokenizers' own libraries and loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = align.byte_of_char()
    documents, linked = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        whole = (" " + text).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        both, groups, links, x, y = set(ends_a) & set(ends_b), [], [], 0, 0
        for end in sorted(both):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(f"{','.join(map(str, ids_a[x:i]))}|{','.join(map(str, ids_b[y:j]))}")
            links.append((ids_a[i - 1], ids_b[j - 1]))
            x, y = i, j
        linked.update(links)
        documents.append((doc_id, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (_, j), n in linked.items():
        best[j] = max(best[j], n)
    return sorted(((d, na, nb, g, len(ls), sum(linked[x] == best[x[1]] for x in ls), sum(linked[x] for x in ls), sha) for d, na, nb, g, ls, sha in documents), key=str)


@pytest.mark.parametrize(("block", "hot"), [(1 << 16, 1_000_000), (37, 5), (9, 0)])
def test_alignment_equals_plain_code(spark, block, hot):
    docs = cases.documents(spark)
    more = [(901, " leading  and   double spaces"), (902, "<s> </s> <0x0A> <|endoftext|>"), (903, "▁ a▁b"), (904, "tab\tand\nline\r\n"), (905, "ﬁ ① é é  x　y")]
    docs = docs.select("doc_id", "text", "n", "row").unionByName(spark.createDataFrame([(*r, "n", "row") for r in more], "doc_id long, text string, n string, row string"))
    got = align.align_tokens(docs, A, B, block, hot)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=str) == plain_alignment(cases.rows_of(docs))


def test_alignment_of_an_empty_table(spark):
    assert align.align_tokens(cases.empty(spark), A, B).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.load(open(A))
    spec["model"]["merges"][5:7] = spec["model"]["merges"][6:4:-1]
    with pytest.raises(ValueError):
        align.ByteLevel(json.dumps(spec).encode())


def plain_audit(rows, labels, part, conditions):
    letters = "".join(conditions)
    ids = defaultdict(set)
    for r in rows:
        ids[r["text"] or ""].add(r["doc_id"])
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[c] == 1} for c in (1, 2))
    failed = []
    for r in rows:
        text, words = r["text"] or "", re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        smaller = [x for x in ids[text] if x is not None and (r["doc_id"] is None or x < r["doc_id"])]
        fails = frozenset(c for c, f in conditions.items() if (bool(smaller) if f is None else f(text, words)))
        failed.append((r[part] or "", fails, r["doc_id"] in good, r["doc_id"] in toxic))
    out, removed = [], Counter()
    for name, order in itertools.product(sorted({f[0] for f in failed}), itertools.permutations(letters)):
        own = [f for f in failed if f[0] == name]
        for step, c in enumerate(order, 1):
            before = set(order[: step - 1])
            here = [f for f in own if c in f[1] and not before & f[1]]
            out.append((name, "".join(order), step, sum(c not in f[1] and not before & f[1] for f in own), len(here), sum(c in f[1] and bool(before & f[1]) for f in own), sum(f[1] == {c} for f in own), sum(f[2] for f in here), sum(f[3] for f in here), (name, c)))
            removed[name, c] += len(here)
    return sorted((*x[:-1], removed[x[-1]]) for x in out)


PLAIN = {
    "A": lambda text, words: len(words) < 200,
    "B": lambda text, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda text, words: 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
    "D": lambda text, words: bool(re.search("[#$%&*|]", text)),
    "E": None,
}


def audited_documents(spark):
    """Odd documents and many short ones that fail each set of filters."""
    docs = cases.documents(spark).select("doc_id", "text", "lang", "n", "level")
    long = " ".join(f"word{i}" for i in range(210))
    texts = [x for mask in range(16) for x in ["".join(["w w w w w ", "" if mask & 1 else long, " w" * (300 * (mask >> 1 & 1)), " A B C D" * (80 * (mask >> 2 & 1)), " $" * (mask >> 3 & 1)])] * (mask % 3 + 1)]
    return docs.unionByName(spark.createDataFrame([(1000 + i, t, "en" if i % 2 else "", "n", "x") for i, t in enumerate(texts)], docs.schema))


def test_audit_equals_plain_code(spark):
    docs = audited_documents(spark)
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    labels = [(i, k % 2, k % 3 == 0 and 1 or 0) for k, i in enumerate(ids)] + [(ids[3], 1, None), (ids[3], 1, 1), (None, 1, 1), (-999, 1, 1)]
    got = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == plain_audit([r.asDict() for r in docs.collect()], labels, "lang", PLAIN)


def test_audit_of_other_filters_and_parts(spark):
    docs = audited_documents(spark)
    some = {"X": lambda text, words: F.length(text) > 100, "Y": lambda text, words: text.contains("w")}
    plain = {"X": lambda text, words: len(text) > 100, "Y": lambda text, words: "w" in text}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.filter_audit(docs, none, "level", some)
    assert sorted(map(tuple, got.collect())) == plain_audit([r.asDict() for r in docs.collect()], [], "level", plain)
    assert audit.filter_audit(cases.empty(spark), none).count() == 0


def test_walsh_sums_are_inverted_exactly(spark):
    counts = [(m, (m * 37) % 11 + (m == 13) * 10**12) for m in range(32) if m % 5]
    rows = spark.createDataFrame([("p", False, False, m, n) for m, n in counts], "part string, good boolean, toxic boolean, mask int, n long")
    cells = audit.walsh_sums(rows, 5).select(audit.inverted(F.col("w"), 5)).first()[0]
    assert cells == [dict(counts).get(m, 0) for m in range(32)]


def plain_digests(conversations):
    out = []
    for conv_id, turns in conversations.items():
        said = [t for role, t in turns if role == "assistant"]
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((conv_id, len(turns), digest("".join(f"{role}\n{t}\n" for role, t in turns)), sum(map(len, said)), digest("".join(said))))
    return sorted(out, key=str)


def odd_conversations(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<\\|im_start|> <\\\\| <| \\|"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (2, None, "user", "last"), (2, 1, None, "no role"),
            (None, 0, "user", "no id"), (None, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (3, 0, "sys\ntem\\n<|im_end|>", "🙂<"), (3, 1, "assistant", "|end\n<|im_end|>\n<"), (4, 0, "assistant", "x" * 100_000), (2**60 + 1, 0, "assistant", "é")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"turn {i} <|") for i in range(300)]
    return rows, spark.createDataFrame([(*r, "c", "p") for r in rows], "conv_id long, turn long, role string, text string, record string, part string")


def in_order(rows):
    out = defaultdict(list)
    for conv_id, _, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        out[conv_id].append((role or "", text or ""))
    return out


@pytest.mark.parametrize("part", [chat.PART, 60, 1])
def test_formatted_conversations_are_read_back(spark, part):
    rows, table = odd_conversations(spark)
    formatted = chat.format_turns(chat.canonical_turns(chat.turn_records(table)), part)
    got = [tuple(r)[:5] for r in chat.read_back(formatted).collect()]
    assert sorted(got, key=str) == plain_digests(in_order(rows))
    if part == 60:
        assert formatted.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 100
        assert all(len(r["formatted"]) < 60 + 200 for r in formatted.where("conv_id <> 4").collect())


def test_format_table_adds_conversations(spark):
    rows, table = odd_conversations(spark)
    more = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]
    got = [tuple(r)[:5] for r in chat.format_table(table, [(-1, more)]).collect()]
    assert sorted(got, key=str) == plain_digests(in_order(rows) | {-1: more})
    assert chat.format_table(table.limit(0)).count() == 0


def test_records_of_many_layouts_become_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 5, "meta": {"x": [1]}},
        {"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q1"}, {"type": "text", "text": "q2"}]}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]},
        {"instruction": "do", "input": "this", "output": "done"},
        {"instruction": "do", "input": "", "output": "done", "history": [["q", "a"], ["q2", "a2"]], "system": "s"},
        {"instruction": "do", "output": "done"},
        {"prompt": "p", "completion": "c"},
        {"prompt": "p", "response": 5},
        {"prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]},
        {"question": "q", "answer": "a", "context": "c", "system": ""},
        {"unknown": 1}, {}, [], "text", None,
    ]
    want = [
        ("messages", ["user:q", "assistant:a"]), ("messages", ["system:s", "user:q", "assistant:"]), ("message_parts", ["user:q1q2", "assistant:a"]), ("speakers", ["user:q", "assistant:a", "tool:t"]),
        ("instruction", ["user:do\n\nthis", "assistant:done"]), ("instruction", ["system:s", "user:q", "assistant:a", "user:q2", "assistant:a2", "user:do", "assistant:done"]), ("instruction", ["user:do", "assistant:done"]),
        ("completion", ["user:p", "assistant:c"]), ("response", ["user:p", "assistant:5"]), ("prompt_messages", ["user:q", "assistant:a"]), ("question", ["user:c\n\nq", "assistant:a"]),
        *[(None, [])] * 5,
    ]
    rows = [(i, 0, None if r is None else json.dumps(r)) for i, r in enumerate(records)] + [(99, 0, "{broken")]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn int, record string"))
    got = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r["conv_id"], r["seq"])):
        got[r["conv_id"]].append(r)
    assert [(got[i][0]["layout"], [f"{r['role']}:{r['text']}" for r in got[i] if r["layout"]]) for i in range(len(records))] == want
    assert got[99][0]["layout"] is None and got[99][0]["fingerprint"] is None
    assert got[4][0]["fingerprint"] != got[6][0]["fingerprint"] and got[0][0]["fingerprint"] != got[1][0]["fingerprint"]
    read = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert read == {i: len(t) for i, (_, t) in enumerate(want) if t}


def test_layouts_that_fit_the_same_records_are_refused():
    with pytest.raises(ValueError):
        chat.Layouts((chat.Layout("a", ("x",), (), may=("y",)), chat.Layout("b", ("x", "y"), ())))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("<|\\ni\n>x", max_size=12), st.text("<|\\im_end\n>é", max_size=20)), max_size=5))
def test_template_is_reversible(turns):
    pieces = [chat.rendered(role, text) for role, text in turns]
    assert list(chat.parsed("".join(p for p, _, _ in pieces))) == turns
    for (piece, start, end), (_, text) in zip(pieces, turns, strict=True):
        assert chat.unescape(piece[start:end]) == text and "<|" not in piece[start:end]
