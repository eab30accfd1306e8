"""Whitening, chat formatting and the Merkle manifest against plain versions, and on odd rows."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oficina.llm import chat, merkle, whitening

# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows, fan):
    """[(id, leaf, subroot, root, proof, folded)] of rows (id, group, leaf, altered)."""

    def up(level):
        return [h(*level[i : i + fan]) for i in range(0, len(level), fan)]

    def climb(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(up(levels[-1]))
        return levels

    def prove(levels, i):
        path = []
        for level in levels[:-1]:
            s = i // fan * fan
            path.append((level[s:i], level[i + 1 : s + fan]))
            i //= fan
        return path

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = climb([r[2] for r in groups[g]])
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = prove(trees[g], i) + prove(top, j)
            cur = r[3]
            for b, a in path:
                cur = h(*b, cur, *a)
            out.append((r[0], r[2], trees[g][-1][0], top[-1][0], "".join(x for b, a in path for x in b + a), cur))
    return out


@pytest.mark.parametrize("fan,deep,sizes", [(3, 4, {"a": 100, "b": 1, None: 7, "é": 82, "": 3}), (2, 2, {"a": 37, "z": 4, None: 1}), (3, 1, {"a": 28, "b": 3}), (5, 3, {"x": 126}), (3, 4, {f"s{i}": 1 + i % 3 for i in range(90)})])
def test_manifest_equals_plain(spark, fan, deep, sizes):
    rows = []
    for g, n in sizes.items():
        for i in range(n):
            # Null ids, repeated ids and equal rows.
            i = None if i == 5 else i // 2 if i % 7 == 0 else i
            rows.append((i, g, h(str(i), str(g)), h(str(i), str(g), "!" if i and i % 3 == 0 else "")))
    df = spark.createDataFrame(rows, "id long, place string, digest string, altered string").withColumnRenamed("place", "grp")
    out = merkle.manifest(df, "grp", ["id"], fan, deep)
    got = out.select("id", "digest", "subroot", "root", merkle.siblings(), merkle.folded(F.col("altered"))).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, plain_manifest(rows, fan)))


def test_manifest_of_whole_rows_with_nulls_and_clashing_columns(spark, tmp_path):
    docs = [(1, "a\nb", "en", "s", 3), (2, None, None, None, None), (None, "", "de", "s", 0), (3, "é\n", "fr", "t", 2), (3, "é\n", "fr", "t", 2), (10, "x\n" * 1000, "en", "s", 2000)]
    docs += [(i, "c\nd", "en", "s", 3) for i in range(20, 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({"size": F.lit(1), "g": F.lit("x"), "place": F.lit(2), "digest": F.lit("y"), "root": F.lit("z")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.query(spark, str(tmp_path)).collect()
    import zlib

    rows = []
    for i, t, lang, s, n in docs:
        leaf = lambda text: h(enc(i), enc(s), enc(lang), enc(n), enc(text))  # noqa: B023, E731
        cut = t.replace("\n", "") if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
        rows.append((i, s, leaf(t), leaf(cut)))
    want = [(i, leaf, sub, root, h(proof), folded, folded == root) for i, leaf, sub, root, proof, folded in plain_manifest(rows, 3)]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, grp string, digest string")
    assert merkle.manifest(df, "grp", ["id"]).collect() == []


# Whitening


def whiten(spark, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    df = df.withColumns({"x": F.lit("clash"), "n": F.lit(1)})
    rows = whitening.points(df, "embedding", ["vec_id"])
    return whitening.whiten(rows, whitening.fit(rows)).collect()


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) / 4).astype(np.float32)
    vectors = [*base.tolist(), *[base[0].tolist()] * 150]
    got = {(r["vec_id"], r["component"]): r for r in whiten(spark, vectors)}
    x = np.floor(256 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    want = (x - fit.mean(axis=0)) @ v[:, :4] / np.sqrt(e[:4])
    assert len(got) == 4 * len(vectors)
    for k in range(4):
        mine = np.array([got[i, k + 1]["whitened"] for i in range(len(vectors))])
        assert min(abs(mine - want[:, k]).max(), abs(mine + want[:, k]).max()) < 1e-9
        assert abs(got[0, k + 1]["explained"] - e[k] / e.sum()) < 1e-12
    assert all(got[i, 1]["n"] == n and got[i, 1]["deviation"] == int(((n * x[i] - s) ** 2).sum()) for i in range(len(vectors)))
    assert {r["identity_error"] for r in got.values()} == {got[0, 1]["identity_error"]} and got[0, 1]["identity_error"] < 1e-9


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    kept = [[0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 5.0]]
    got = whiten(spark, [*kept, None, [nan, 1.0], [inf, 0.0], [None, 1.0], [1.0], [1.0, 2.0, 3.0], []])
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(i, k) for i in range(4) for k in (1, 2)]
    assert {r["n"] for r in got} == {3} and abs(sum(r["explained"] for r in got if r["vec_id"] == 0) - 1) < 1e-12
    # All on one line: one component. All equal, or none: no component, so no rows.
    assert {r["component"] for r in whiten(spark, [[float(i), float(2 * i), 0.0] for i in range(9)])} == {1}
    assert whiten(spark, [[1.0, 2.0]] * 5) == [] and whiten(spark, [[1.0, 2.0]]) == [] and whiten(spark, [None]) == []
    # Entries beyond whole numbers of 64 bits keep their rows; their deviation has no place in 64 bits.
    far = whiten(spark, [[3e38, 1.0], [-3e38, 2.0], [1.0, 3.0]])
    assert len(far) and {r["deviation"] for r in far if r["vec_id"] == 0} == {None}


def test_exact_sums_and_deviations_beyond_64_bits():
    m = np.array([[2**40, -(2**62)], [3, 5]])
    sums = [2**40 + 3, 5 - 2**62]
    assert whitening.deviations(m, 2, sums) == [sum((2 * int(x) - s) ** 2 for x, s in zip(r, sums)) for r in m.tolist()]


# Chat formatting


def read_back(turns, template=chat.INST):
    found = chat.trace(turns, template.render)
    return found, template.read(found.text)


def test_control_strings_come_back():
    rng = random.Random(5)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", ">", "[", "]", "/", " ", "\n", "é", "ab", "S", "chat.MARK", chat.MARK]
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool\nx", "a\\<s>"]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 6))]
        found, back = read_back(turns)
        assert back == turns and not found.rewrites
        for (role, text), span, at in zip(turns, found.spans, found.texts):
            assert span[0] <= at[0] <= at[1] <= span[1]
            assert chat.unescaped(found.text[at[0] : at[1]]) == text
            assert not any(c in found.text[at[0] : at[1]] for c in chat.CONTROLS)
        assert [s[0] for s in found.spans] == [0, *[s[1] for s in found.spans]][: len(turns)]
        assert chat.loss_text(turns, found, chat.INST) == "".join(t for r, t in turns if r == "assistant")


def chatml(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def no_old_thoughts(turns):
    """Takes the thoughts out of all assistant turns but the last one."""
    last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
    return chatml([(r, t.split("</think>")[-1] if r == "assistant" and i < last else t) for i, (r, t) in enumerate(turns)])


def closing(turns):
    return chatml(turns) + "<|end|>"


def test_templates_that_rewrite_history():
    turns = [("user", "q1"), ("assistant", "<think>hm</think>a1"), ("user", "q2"), ("assistant", "<think>so</think>a2")]
    assert not chat.rewrites_history(chat.Template(chatml), turns)
    found = chat.trace(turns, no_old_thoughts)
    assert found.rewrites == [2] and found.spans[1] is None and found.texts[1] is None
    assert chat.loss_text(turns, found, chat.Template(no_old_thoughts)) == "<think>so</think>a2"
    # An end mark is rewritten by every turn, but the turns before it stay where they are.
    found = chat.trace(turns, closing)
    assert found.rewrites == [0, 1, 2, 3] and chat.loss_text(turns, found, chat.Template(closing)) == "<think>hm</think>a1<think>so</think>a2"


def test_a_template_that_trims_texts():
    turns = [("user", "  q "), ("assistant", " a\n")]
    found = chat.trace(turns, lambda ts: chatml([(r, t.strip()) for r, t in ts]))
    assert chat.loss_text(turns, found, chat.Template(chatml)) == "a"


def test_odd_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (None, None, None, None), (None, 0, "user", "x"), (2, 0, "user", "y" * 200_000), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"spans": F.lit(1), "__c": F.lit(2)})
    got = {r["conv_id"]: r for r in chat.formatted(df, "conv_id", "turn", "role", "text").collect()}
    assert got[1]["text"] == "<s>[INST] a [/INST] b</s> b</s>" and got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2
    assert got[None]["text"] == "<<SYS>>\n<</SYS>><s>[INST] x [/INST]" and got[2]["formatted_chars"] == 200_018
    assert got[3]["loss_chars"] == 0 and got[3]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chat.formatted(df.limit(0), "conv_id", "turn", "role", "text").collect() == []


def test_a_long_conversation(spark):
    turns = [(i, "user" if i % 2 == 0 else "assistant", f"text {i} [INST]") for i in range(1500)]
    df = spark.createDataFrame([(7, *t) for t in turns], "conv_id long, turn long, role string, text string")
    (row,) = chat.formatted(df, "conv_id", "turn", "role", "text").collect()
    assert row["n_turns"] == 1500 and json.dumps(row["rewrites"]) == "[]"
    assert row["loss_sha256"] == hashlib.sha256("".join(t for _, r, t in turns if r == "assistant").encode()).hexdigest()
