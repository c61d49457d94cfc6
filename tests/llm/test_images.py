import random

import numpy as np

from spanlattice.llm.chunking import cut, edited_pieces, landmarks, natural_boundaries, pieces
from spanlattice.llm import packed
from spanlattice.llm.crosssplit import CrossSplit, cross_split, index_tokens, max_bad, overlap_report, probe_tokens
from spanlattice.llm.neardup import NearDuplicates

PATCH = "patch_id bigint, file_path string, dataset string, y0 int, y1 int, x0 int, x1 int, dtype string, image binary, h int, token string, cls int"
CONFIG = "run_name string, train_dir string, additional_train_dirs array<string>, eval_dir string, dataset string"


def patch(i, levels, path, dataset="d", wide=False):
    data = (levels.astype("<u2") * 257 + 100 * (levels < 255)).astype("<u2") if wide else levels.astype(np.uint8)
    return (i, path, dataset, 3, 3 + levels.shape[0], 5, 5 + levels.shape[1], "uint16" if wide else "uint8", data.tobytes(), 1, "t", 2)


def images(seed=7, n=24):
    rng = np.random.default_rng(seed)
    rnd = random.Random(seed)
    dirs = ["/p/base/train/", "/p//base/./eval/", "/p/base/evaluation/", "/p/more/", "p/base/eval/"]
    rows, i = [], 0
    for _ in range(n):
        h, w = rnd.choice([(9, 14), (16, 12), (10, 9)])
        base = rng.integers(0, 256, (h, w))
        if rnd.random() < 0.3:
            base[: h // 2] = 7  # partly flat
        for _ in range(rnd.randrange(1, 5)):
            x = np.clip(base + rng.integers(-3, 4, (h, w)) * (rnd.random() < 0.6), 0, 255)
            bad = rnd.choice([0, 0, max_bad(h * w, 0.95), max_bad(h * w, 0.95) + 1])
            flat = x.reshape(-1)
            at = rng.permutation(h * w)[:bad]
            flat[at] = (flat[at] + 40) % 256
            if rnd.random() < 0.3:
                x = np.vstack([x[3:], x[:3]])  # lines in another order
            i += 1
            rows.append(patch(i, x, rnd.choice(dirs) + f"s/images/{i}.tiff", rnd.choice(["a", "b", None]), rnd.random() < 0.3))
    for dirt in (None, b"", b"\x01\x02"):
        i += 1
        rows.append((i, "/p/base/train/x.tiff", "a", 0, 9, 0, 14, "uint8", dirt, 1, "t", 2))
    still = np.full((9, 14), 9)
    rows += [patch(i + 1, still, "/p/base/train/x"), patch(i + 2, still, "/p/base/eval/x"), (None, *rows[0][1:]), (i + 3, None, *rows[0][2:]), (i + 4, *rows[0][1:7], None, *rows[0][8:]), (i + 5, *rows[0][1:3], None, *rows[0][4:]), (i + 6, *rows[0][1:3], -(2**31), 2**31 - 1, -(2**31), 2**31 - 1, *rows[0][7:])]
    return rows + rows[:4]


CONFIGS = [("r1", "/p/base/train//", [None, "/p/more", "/p/more/."], "/p/base/eval", "x"), ("r2", None, None, "/p/base", "x"), ("r2", "/p/more", [], None, "x"), ("r3", "/p/base/eval", ["/p/base/train"], "/p/base/eval", None), (None, "/p/base/train", None, "/p/base/eval", "x"), ("r4", "", ["/"], "/p/base/eval", "x")]


def usable(rows):
    out = {}
    for r in rows:
        i, path, dataset, y0, y1, x0, x1, dtype, data = r[:9]
        if i is None or data is None or y0 is None or dtype not in ("uint8", "uint16"):
            continue
        h, w = y1 - y0, x1 - x0
        if len(data) != h * w * (2 if dtype == "uint16" else 1):
            continue
        g = np.frombuffer(data, "<u2") // 257 if dtype == "uint16" else np.frombuffer(data, np.uint8)
        if int(g.max()) - int(g.min()) > 3:
            out[i] = (g.astype(int).reshape(h, w), path, dataset)
    return out


def clean(p):
    steps = [x for x in (p or "").split("/") if x not in ("", ".")]
    return ("/" if (p or "").startswith("/") else "") + "/".join(steps) if steps else None


def brute_cross(rows, configs):
    u, out = usable(rows), set()
    ev, tr = {}, {}
    for run, train, more, eval_, _ in configs:
        if run is not None:
            ev.setdefault(run, set()).add(clean(eval_))
            tr.setdefault(run, set()).update(clean(d) for d in [train, *(more or [])])
    below = lambda p, dirs: p is not None and any(d and clean(p).startswith(d + "/") for d in dirs)
    for run in ev:
        for a, (ga, pa, da) in u.items():
            for b, (gb, pb, _) in u.items():
                if a != b and ga.shape == gb.shape and below(pa, ev[run]) and below(pb, tr[run]) and (abs(ga - gb) <= 3).sum() * 100 >= 95 * ga.size:
                    out.add((run, da, min(a, b), max(a, b)))
    return out


def brute_near(rows):
    sets = {}
    for i, (g, *_) in usable(rows).items():
        s = {tuple(line[k : k + 8]) for line in g.tolist() for k in range(len(line) - 7)}
        if s:
            sets[i] = s
    return {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}


def test_cross_split(spark):
    for seed in (7, 8):
        rows = images(seed)
        got = cross_split(spark.createDataFrame(rows, PATCH), spark.createDataFrame(CONFIGS, CONFIG)).select("run_name", "dataset", "patch_id1", "patch_id2").collect()
        want = brute_cross(rows, CONFIGS)
        assert want and len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_cross_split_empty(spark):
    no_patch, no_config = spark.createDataFrame([], PATCH), spark.createDataFrame([], CONFIG)
    assert cross_split(no_patch, spark.createDataFrame(CONFIGS, CONFIG)).count() == 0
    found = cross_split(spark.createDataFrame(images(), PATCH), no_config)
    assert overlap_report(found).count() == 0


def test_tokens_lose_no_pair():
    """A pair at the limit always shares a token, whichever shingles the sketch favours."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        h, w = int(rng.integers(1, 14)), int(rng.integers(1, 20))
        a = rng.integers(0, 256, h * w)
        b = np.clip(a + rng.integers(-3, 4, h * w), 0, 255)
        at = rng.permutation(h * w)[: max_bad(h * w, 0.95)]
        b[at] = (b[at] + 99) % 256
        sketch = rng.integers(0, 50, 1 << packed.SKETCH_BITS)
        which, found = index_tokens(np.stack([a, b]).astype(np.uint8), h, w, 0.95, 3, sketch)
        probes = probe_tokens(np.stack([a, b]).astype(np.uint8), h, w, 0.95)
        assert np.isin(found[which == 0], probes[1]).any() and np.isin(found[which == 1], probes[0]).any()


def shared_token(n=60):
    """Images that all have their first two lines in common, and some near copies of them."""
    rng = np.random.default_rng(5)
    top = rng.integers(0, 256, (2, 14))
    rows = []
    for i in range(n):
        x = np.vstack([top, rng.integers(0, 256, (7, 14))])
        for k in range(rng.integers(1, 4)):
            y = x.copy()
            y[8, :k] += 1
            rows.append(patch(3 * i + k, np.clip(y, 0, 255), ["/p/base/train/", "/p/base/eval/"][k % 2] + f"{i}"))
    return rows


def test_hot_tokens_are_split(spark):
    """Tokens that all images share, spread over many cells, lose no pair and make none twice."""
    for rows in (shared_token(), images(11)):
        df, config = spark.createDataFrame(rows, PATCH), spark.createDataFrame(CONFIGS, CONFIG)
        near, want = NearDuplicates(df, list_limit=1).image_pairs().collect(), brute_near(rows)
        assert want and len(near) == len(set(near)) and {tuple(r) for r in near} == want
        cross, want = CrossSplit(df, config, list_limit=1).image_pairs().collect(), brute_cross(rows, CONFIGS)
        assert want and len(cross) == len(set(cross)) and {tuple(r) for r in cross} == want


def test_cells_meet():
    """However tokens are split, entries of equal tokens meet, and others do not."""
    rng = np.random.default_rng(4)
    token, part = rng.integers(0, 5, 200).astype(np.uint64), rng.integers(0, 2**60, 200).astype(np.uint64)
    cells = np.array([1, 7, 3, 1, 20])[token.astype(int)]
    entry, key = packed.in_cells(token, cells, part, True)
    met = {(i, j) for k in set(key.tolist()) for i in entry[key == k].tolist() for j in entry[key == k].tolist()}
    assert met == {(i, j) for i in range(200) for j in range(200) if token[i] == token[j]}
    (e1, k1), (e2, k2) = (packed.in_cells(token, cells, part, False, side) for side in (True, False))
    met = [(i, j) for k in set(k1.tolist()) for i in e1[k1 == k].tolist() for j in e2[k2 == k].tolist()]
    assert len(met) == len(set(met)) and set(met) == {(i, j) for i in range(200) for j in range(200) if token[i] == token[j]}


def test_prefix_orders(monkeypatch):
    """Either way of sorting gives one order, which does not depend on what else an image holds."""
    from spanlattice.llm import neardup

    rng = np.random.default_rng(3)
    levels = rng.integers(0, 3, (40, 90)).astype(np.uint8)
    tokens, new = neardup.sequences(levels, 9, 10, 8)
    rarity = (packed.mix(tokens, 5) % np.uint64(3)).astype(np.uint8)
    row, column, pos = neardup.prefixes(tokens, new, rarity, 1, 0.6)
    assert all(new[row, column]) and (np.bincount(row, minlength=40) == neardup.prefix_length(new.sum(axis=1), 0.6)).all()
    rank = lambda r, c: (rarity[r, c], int(packed.mix(tokens, 1)[r, c]) >> 30, tokens[r, c])
    for r in range(40):
        want = sorted((c for c in range(tokens.shape[1]) if new[r, c]), key=lambda c: rank(r, c))
        assert column[row == r].tolist() == want[: (row == r).sum()] and pos[row == r].tolist() == list(range((row == r).sum()))


def test_packing():
    rng = np.random.default_rng(6)
    packer, sent = packed.Packer(5), []
    rows = []
    for _ in range(3):
        owners, which, tokens = rng.integers(0, 99, 4), rng.integers(0, 4, 50), packed.mix(rng.integers(0, 30, 50))
        marks = rng.integers(0, 256, 50).astype(np.uint8)
        sent += list(zip(owners[which].tolist(), (owners * 2)[which].tolist(), (tokens & np.uint64(2**32 - 1)).tolist(), marks.tolist()))
        rows += list(packer.add(owners, owners * 2, which, tokens, marks))
    rows += list(packer.flush())
    got = [e for cols in packed.buckets_of(iter(rows)) for e in zip(*(c.tolist() for c in cols))]
    assert sorted(got) == sorted(sent)


def reach(x, pairs):
    """What is linked to x, directly or over others."""
    got, new = {x}, {x}
    while new := {b for p in pairs for a, b in (p, p[::-1]) if a in new} - got:
        got |= new
    return got


def test_near_duplicates(spark):
    for seed in (7, 9):
        rows = images(seed)
        near = NearDuplicates(spark.createDataFrame(rows, PATCH))
        got = near.image_pairs().collect()
        want = brute_near(rows)
        assert want and len(got) == len(set(got)) and {tuple(r) for r in got} == want
        groups = near.image_groups().collect()
        assert len(groups) == len({r.patch_id for r in groups})
        of = {r.patch_id: r.group_id for r in groups}
        assert all(of[a] == of[b] for a, b in want)
        assert of == {x: min(reach(x, want)) for x in of}


def test_compact_cross_split(spark):
    rows = images()
    u = usable(rows)
    got = CrossSplit(spark.createDataFrame(rows, PATCH), spark.createDataFrame(CONFIGS, CONFIG))
    pairs, compact = {tuple(r) for r in got.image_pairs().collect()}, got.images().collect()
    ends = {(run, i) for run, _, a, b in pairs for i in (a, b)}
    assert {(r.run_name, r.patch_id) for r in compact} <= ends and all(u[r.patch_id][2] == r.dataset for r in compact)
    for r in compact:  # as many classes as there are different images among the counterparts
        partners = {(a if b == r.patch_id else b) for run, _, a, b in pairs if run == r.run_name and r.patch_id in (a, b)}
        assert 1 <= r.n_links <= len({u[i][0].tobytes() for i in partners})


def test_near_duplicates_empty(spark):
    near = NearDuplicates(spark.createDataFrame([], PATCH))
    assert near.image_pairs().count() == 0 and near.image_groups().count() == 0


def brute_cut(n, natural, most):
    begin, out = 0, []
    while n - begin > most:
        fits = [z for z in range(begin + 3, begin + most + 1) if natural[z]]
        end = max(fits) if fits else begin + most
        out.append((begin, end))
        begin = end - 2
    return [*out, (begin, n)]


def test_cut():
    rnd = random.Random(1)
    for _ in range(300):
        n, most = rnd.randrange(1, 60), rnd.randrange(3, 20)
        natural = np.array([False] + [rnd.random() < 0.2 for _ in range(n - 1)])
        assert cut(n, natural, None, most, 3, 2) == brute_cut(n, natural, most)
        marked = cut(n, natural, np.array([rnd.random() < 0.2 for _ in range(n)]), most, 3, 2)
        assert marked[0][0] == 0 and marked[-1][1] == n and all(0 < e - b <= most for b, e in marked) and all(b2 == e1 - 2 for (_, e1), (b2, _) in zip(marked, marked[1:]))
    assert cut(4, np.zeros(4, bool), None, 0, 3, 2) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_edit_alters_neighbours_only():
    altered = []
    for seed in range(40):
        rng = np.random.default_rng(seed)
        lines = rng.integers(0, 256, (400, 16)).astype(np.uint8)
        at = int(rng.integers(20, 380))
        edited = np.vstack([lines[:at], rng.integers(0, 256, (3, 16)).astype(np.uint8), lines[at:]])
        of = lambda x: cut(len(x), natural_boundaries(x), landmarks(x, 3), 32, 3, 2)
        before, after = set(of(lines)), {(a, b) if b <= at else (a - 3, b - 3) for a, b in of(edited) if b <= at or a >= at + 3}
        altered.append(len(before - after))
    assert max(altered) <= 8 and sum(altered) / len(altered) <= 4  # of some fifty pieces each


def test_rolling_hash():
    """A line is marked by the lines just before it, wherever they stand."""
    rng = np.random.default_rng(4)
    lines = rng.integers(0, 256, (300, 7)).astype(np.uint8)
    marks, moved = landmarks(lines, 2), landmarks(np.vstack([rng.integers(0, 256, (11, 7)).astype(np.uint8), lines]), 2)
    assert (marks[3:] == moved[14:]).all() and 0.15 < marks.mean() < 0.35 and not marks[:3].any()
    assert [len(landmarks(lines[:n], 2)) for n in (1, 2, 3)] == [1, 2, 3]


def test_edited_pieces(spark):
    from pyspark.sql import functions as F

    rows = [patch(i, np.random.default_rng(i).integers(0, 256, (120, 8)), "x") for i in range(30)] + [patch(99, np.zeros((3, 3)), "x")]
    span = lambda a, b: F.col(b) - F.col(a)
    get = lambda bits: edited_pieces(spark.createDataFrame(rows, PATCH), "image", "patch_id", "image", "dtype", span("y0", "y1"), span("x0", "x1"), 128, landmark_bits=bits).collect()
    marked, plain = get(2), get(None)
    assert len(marked) == len(plain) == 30 and all(0 < r.n_altered <= r.n_after for r in marked)
    share = lambda got: sum(r.n_altered for r in got) / sum(r.n_after for r in got)
    assert share(marked) < 0.35 < share(plain)  # without landmarks nor boundaries all later pieces move


def test_pieces(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    big = rng.integers(0, 256, (50, 20))
    big[17] = 4
    wide = rng.integers(0, 256, (3, 600))
    rows = [patch(1, big, "x"), patch(1, big, "y", wide=True), patch(2, big[:25], "x"), patch(3, wide, "x"), (4, "x", "d", 0, 50, 0, 20, "uint8", b"\0", 1, "t", 2), (5, "x", "d", 0, None, 0, 20, "uint8", b"\0" * 1000, 1, "t", 2), (None, *patch(1, big, "x")[1:])]
    span = lambda a, b: F.col(b) - F.col(a)
    get = lambda r: pieces(spark.createDataFrame(r, PATCH), "image", "patch_id", "image", "dtype", span("y0", "y1"), span("x0", "x1"), 512)
    got = sorted(tuple(r)[1:] for r in get(rows).collect())
    assert got == [(1, 0, 0, 18), (1, 1, 16, 41), (1, 2, 39, 50), (3, 0, 0, 1), (3, 1, 1, 2), (3, 2, 2, 3)]
    assert get([]).count() == 0
