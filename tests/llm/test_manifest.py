"""The manifest against a plain tree, in one block and in many rounds."""

import hashlib
import zlib

import duckdb
import pytest

from edgeframe.llm import manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, grp string, at int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    out = []
    for k in range(300):
        text = [f"Text {k} \u00e9", "", None, "same", "A" * 70_000][k % 5 if k < 20 else 0]
        source = [None, "", "b", "\u00e9", "B"][k % 7 % 5] if k < 40 else "big"
        out.append((k, text, [None, "en"][k % 2], source, k * 3 if k % 3 else None, "x", k))
    return out + [(5, "Tie", "en", "b", 1, None, None)] * 2 + [(None, "No id", None, "b", 2, "", 1),
                                                               (900, "Alone", "en", "one", 5, "", 2)]


def leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes):
    """Levels of a tree over ``nodes``."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k:k + 16])) for k in range(0, len(last), 16)])
    return levels


def path(levels, at):
    """(slot, run) of every level but the root's."""
    for level in levels[:-1]:
        yield at % 16, level[at // 16 * 16:at // 16 * 16 + 16]
        at //= 16


def plain(data):
    groups = {}
    for r in data:
        now = r[1].translate({c: c + 32 for c in range(65, 91)}) if r[1] and r[0] is not None \
            and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1]
        groups.setdefault(r[3], []).append(
            ((r[0] is not None, r[0]), leaf(*r[:5]), leaf(r[0], now, *r[2:5])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(groups[s])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for at, ((_, doc_id), own, now) in enumerate(sorted(groups[s])):
            way = [*path(trees[s], at), *path(top, n)]
            proof = "".join(x for slot, run in way for k, x in enumerate(run) if k != slot)
            value = now
            for slot, run in way:
                value = sha("".join([*run[:slot], value, *run[slot + 1:]]))
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], sha(proof), value,
                        value == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tall", [manifest.HEIGHT, 1, 2])
def test_against_plain_tree(spark, tall, monkeypatch):
    monkeypatch.setattr(manifest.manifest, "__kwdefaults__",
                        manifest.manifest.__kwdefaults__ | {"tall": tall})
    got = manifest.op13(spark.createDataFrame(rows(), SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows())


def test_proofs_verify_and_sql_agrees(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    made = manifest.manifest(docs, with_proof=True, tall=1).collect()
    assert all(r.verified and r.folded_root == r.root for r in made)
    for r in made[::20]:
        levels = [{"slot": p.slot, "run": p.run} for p in r.proof]
        proof = manifest.proof_of(levels)
        assert manifest.folded(r.leaf, proof) == r.root
        assert manifest.folded(sha("x"), proof) != r.root
        assert manifest.digest(manifest.siblings(proof)) == r.proof_sha256
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, "
                "source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows()])
    assert sorted(con.execute(manifest.SQL).fetchall(), key=repr) == plain(rows())


def test_queue_stays_small_and_small_tables(spark):
    leaves = [sha(str(k)) for k in range(4096)]
    nodes = manifest.sweep_up(leaves, 3)
    assert nodes[-1][3] == climb(leaves)[-1][0] and len(nodes) == 256 + 16 + 1
    empty = manifest.op13(spark.createDataFrame([], SCHEMA))
    assert empty.columns[0] == "doc_id" and empty.count() == 0
    one = rows()[:1]
    assert [tuple(r) for r in manifest.op13(spark.createDataFrame(one, SCHEMA)).collect()] == plain(one)
