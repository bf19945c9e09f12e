"""The style cascade against a plain fold, step by step."""

import json
import random

from stratadoc.operators import styles as S


def plain_effective(occurrence, styles, properties):
    values, trails = {}, {}

    def apply(layer, source, rows):
        for path, value, toggle, tabs in sorted(rows, key=lambda r: r[0]):
            action = "set"
            if path == S.TABS:
                now = {x["position"]: x["alignment"] for x in json.loads(values.get(path) or "[]")}
                now.update(tabs or {})
                value, action = json.dumps([{"position": k, "alignment": v} for k, v in sorted(now.items()) if v != "clear"], separators=(",", ":")), "merge"
                value = None if value == "[]" else value
            elif toggle and layer.endswith("_style"):
                before = values.get(path) or "false"
                value, action = (("false" if before == "true" else "true"), "toggle") if value == "true" else (before, "toggle_noop")
            values[path] = value
            trails.setdefault(path, []).append((layer, source, action, value))

    of = lambda layer, owner, part=None: [r[3:] for r in properties if r[0] == layer and r[1] == owner and part in (None, r[2])]

    def chain(style, kind):
        out = []
        while style is not None:
            if style in out:
                return []
            if style not in styles or styles[style][1] != kind:
                break
            out.append(style)
            style = styles[style][0]
        return out[::-1]

    name, paragraph, character = occurrence
    apply("doc_defaults", None, of("doc_defaults", None, "run"))
    apply("doc_defaults", None, of("doc_defaults", None, "paragraph"))
    for style in chain(paragraph, "paragraph"):
        apply("paragraph_style", style, of("style", style, "paragraph"))
        apply("paragraph_style", style, of("style", style, "run"))
    apply("paragraph_direct", name, of("paragraph_direct", name))
    apply("paragraph_mark_direct", name, of("paragraph_mark_direct", name))
    for style in chain(character, "character"):
        apply("character_style", style, of("style", style, "run"))
    apply("run_direct", name, of("run_direct", name))
    for path, other in (("run.font_ascii", "run.font_hansi"), ("run.font_hansi", "run.font_ascii")):
        if path not in values and other in values:
            values[path] = values[other]
            trails[path] = [*trails[other], ("word_font_fallback", other, "derive", values[other])]
    for path, value in S.IMPLICIT.items():
        if path not in values:
            values[path] = value
            trails[path] = [("word_implicit_default", "ECMA-376", "default", value)]
    return {p: (values[p], trails[p]) for p in values}


def test_effective_styles(spark):
    rng = random.Random(12)
    styles = {f"p{k}": (f"p{rng.randrange(k)}" if k and k % 3 else None, "paragraph") for k in range(12)} | {f"c{k}": (f"c{k - 1}" if k else None, "character") for k in range(4)}
    styles |= {"x1": ("x2", "paragraph"), "x2": ("x1", "paragraph"), "m": ("gone", "paragraph"), "w": ("c1", "paragraph")}
    paths = {"run": ["run.bold", "run.italic", "run.font_ascii", "run.font_hansi", "run.size"], "paragraph": ["paragraph.alignment", S.TABS]}

    def some(layer, owner, part, share):
        for path in paths[part]:
            if rng.random() < share:
                toggle = path in ("run.bold", "run.italic")
                tabs = {rng.randrange(4) * 100: rng.choice(["left", "right", "clear"]) for _ in range(2)} if path == S.TABS else None
                yield layer, owner, part, path, None if tabs else rng.choice(["true", "true", "false"]) if toggle else rng.choice(["a", "b", "c"]), toggle, tabs

    occurrences = [(f"o{k}", rng.choice([*[s for s in styles if s[0] != "c"], "gone", None]), rng.choice(["c0", "c2", "c3", "p1", None])) for k in range(60)]
    properties = [r for s in styles for part in paths for r in some("style", s, part, 0.4)] + [r for part in paths for r in some("doc_defaults", None, part, 0.3)]
    properties += [r for o, _, _ in occurrences for layer, part in (("paragraph_direct", "paragraph"), ("paragraph_mark_direct", "run"), ("run_direct", "run")) for r in some(layer, o, part, 0.15)]
    got = {}
    rows = S.effective_styles(
        spark.createDataFrame(occurrences, "occurrence_id string, paragraph_style string, character_style string"),
        spark.createDataFrame([(s, *v) for s, v in styles.items()], "style_id string, based_on string, style_type string"),
        spark.createDataFrame(properties, "layer string, owner string, part string, path string, value string, toggle boolean, tabs map<int,string>"),
    ).collect()
    for r in rows:
        assert got.setdefault(r.occurrence_id, {}).setdefault(r.path, (r.value, [tuple(x) for x in r.trail])) is not None
    assert got == {o[0]: plain_effective(o, styles, properties) for o in occurrences}
    actions = {a for o in got.values() for _, trail in o.values() for _, _, a, _ in trail}
    assert actions == {"set", "merge", "toggle", "toggle_noop", "derive", "default"}


def test_styles_are_worked_out_once_a_pair(spark):
    styles = {"p": (None, "paragraph"), "q": ("p", "paragraph"), "c": (None, "character")}
    properties = [("style", "p", "run", "run.bold", "true", True, None), ("style", "q", "paragraph", S.TABS, None, False, {10: "left"}), ("style", "p", "run", "run.font_ascii", "a", False, None), ("style", "c", "run", "run.bold", "true", True, None), ("doc_defaults", None, "run", "run.size", "11", False, None)]
    occurrences = [(f"{p}{c}{k}", p, c) for p in ("p", "q", "gone", None) for c in ("c", None) for k in range(6)]
    for name, _, _ in occurrences:
        direct = {"1": [("paragraph_direct", "paragraph", S.TABS, None, {10: "clear"})], "2": [("run_direct", "run", "run.font_hansi", "h", None)], "3": [("paragraph_mark_direct", "run", "run.bold", "false", None), ("run_direct", "run", "run.font_ascii", None, None)], "4": [("run_direct", "run", "run.color", "red", None)]}
        properties += [(layer, name, part, path, value, False, tabs) for layer, part, path, value, tabs in direct.get(name[-1], [])]
    df = S.effective_styles(
        spark.createDataFrame(occurrences, "occurrence_id string, paragraph_style string, character_style string"),
        spark.createDataFrame([(s, *v) for s, v in styles.items()], "style_id string, based_on string, style_type string"),
        spark.createDataFrame(properties, "layer string, owner string, part string, path string, value string, toggle boolean, tabs map<int,string>"),
    )
    got = {}
    for r in df.collect():
        assert r.path not in got.setdefault(r.occurrence_id, {})
        got[r.occurrence_id][r.path] = (r.value, [tuple(x) for x in r.trail])
    assert got == {o[0]: plain_effective(o, styles, properties) for o in occurrences}
    # implicit values are put in below the join that brings them to occurrences, and no test of the rows works them out again
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join")]
    assert "ECMA-376" in plan and "ECMA-376" not in top and "Filter" not in top
