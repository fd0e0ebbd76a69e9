"""Ignore rules as a table, and listing level by level."""

import random
import re

from stratagraph.core import stored
from stratagraph.sources import files


def plain(path, rules):
    """The last rule that matches decides; rules come in their own order."""
    out = False
    for regex, hit in rules:
        if regex.match(path):
            out = hit
    return out


def test_five_thousand_rules(spark):
    """Names, paths, endings, globs, exceptions and folders over ten thousand paths."""
    rnd = random.Random(8)
    names = [f"n{k}" for k in range(400)]
    folders = ["", "src", "src/n1", "lib", "lib/n2/n3"]
    texts = {}
    for _ in range(5000):
        name = rnd.choice(names)
        line = rnd.choice([name, f"{name}/", f"/{name}", f"{name}/{rnd.choice(names)}", f"*.{name}", f"{name[:2]}?{name[2:]}", f"!{name}", f"!*.{name}", f"{name}.*/"] + ["# note"])
        texts.setdefault(rnd.choice(folders), []).append(line)
    rows = [r for f, lines in texts.items() for r in files.ignore_rules("\n".join(lines), f)]
    assert len(rows) > 4000 and {r[1] for r in rows} == {"name", "path", "ending", "glob"}
    paths = {"/".join([*filter(None, [rnd.choice(folders)]), *(rnd.choice([*names[:40], *(f"{n}.{rnd.choice(names)}" for n in names[:20])]) for _ in range(rnd.randint(1, 4)))]) for _ in range(10_000)}
    got = {r[0] for r in files.ignored(spark.createDataFrame([(p,) for p in sorted(paths)], "path string").repartition(4), stored(spark.createDataFrame(rows, files.RULES))).collect()}
    ordered = [(re.compile(files.rule_regex(r)), r[4]) for r in sorted(rows, key=lambda r: r[5])]
    some = set(rnd.sample(sorted(paths), 400)) | {"src/n1/n5", "n3"}
    assert {p for p in some & paths if plain(p, ordered)} == got & some and 0.05 < len(got) / len(paths) < 0.95


def test_rules_mean_what_lines_say():
    rules = {r[1]: r for r in files.ignore_rules("a.b\n/top\n*.log\nx[0-9]*\nsub/dir/\n!keep/\n", "in/side", 1)}
    assert rules["name"][:5] == ("in/side", "name", "keep", True, False) and rules["ending"][2] == ".log"
    hits = lambda kind, path: bool(re.search(files.rule_regex(rules[kind]), path))
    assert hits("ending", "in/side/q/a.log/z") and not hits("ending", "in/a.log") and not hits("ending", "in/side/alog")
    assert hits("glob", "in/side/q/x1y") and not hits("glob", "in/side/xy")
    assert hits("path", "in/side/sub/dir/f") and not hits("path", "in/side/sub/dir") and not hits("path", "in/side/q/sub/dir/f")


def test_one_deep_folder_is_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    for k in range(60):
        for m in range(3):
            (tmp_path / f"src/p{k}/q{m}").mkdir(parents=True)
            (tmp_path / f"src/p{k}/q{m}/f.txt").write_text("x")
    (tmp_path / "src/top.txt").write_text("x")
    made = []
    monkeypatch.setattr(files, "stored", lambda df: made.append(df.rdd.getNumPartitions()) or stored(df))
    found = {r["path"] for r in files.listed(spark, str(tmp_path)).collect()}
    assert found == {"src/top.txt", *(f"src/p{k}/q{m}/f.txt" for k in range(60) for m in range(3))}
    assert len(made) == 4 and made[2] >= 4 and made[3] >= 4
