"""Preset roles against a plain recursive merge."""

import json
import random

from stratadoc.operators import styles as S


def plain_roles(roles, values, profiles, required, parameters):
    """The same by nested dicts, role by role."""

    def put(into, path, value):
        *above, last = path.split(".")
        for part in above:
            if not isinstance(into.get(part), dict):
                into[part] = {}
            into = into[part]
        into[last] = value

    def over(base, update):
        out = dict(base)
        for k, v in update.items():
            out[k] = over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
        return out

    def nested(rows):
        out = {}
        for path, value in rows:
            put(out, path, value)
        return out

    good, wrong = {}, set()
    for role, (kind, _) in roles.items():
        seen, at, bad = [], role, None
        while at is not None:
            if at in seen:
                bad = "role_cycle", at
            elif at not in roles:
                bad = "role_missing", at
            elif roles[at][0] != kind:
                bad = "type_mismatch", at
            if bad:
                break
            seen.append(at)
            at = roles[at][1]
        codes = [bad] if bad else []
        if kind not in required:
            codes.append(("type_unknown", kind))
        elif kind not in profiles:
            codes.append(("profile_missing", kind))
        wrong |= {(role, *c) for c in codes}
        if codes:
            continue
        all_ = nested(profiles[kind].items())
        for at in reversed(seen):
            for layer in (False, True):
                all_ = over(all_, nested([(p, v) for r, o, p, v in values if r == at and o == layer]))

        def replaced(x):
            if isinstance(x, dict):
                return {k: replaced(v) for k, v in x.items()}
            if x is not None and x.startswith("${") and x.endswith("}"):
                if x[2:-1] not in parameters:
                    wrong.add((role, "parameter_missing", x[2:-1]))  # noqa: B023
                return parameters.get(x[2:-1])
            return x

        all_ = replaced(all_)
        for path in required[kind]:
            x = all_
            for part in path.split("."):
                x = x[part] if isinstance(x, dict) and part in x else KeyError
            if x is KeyError:
                wrong.add((role, "path_missing", path))
            elif x in (None, ""):
                wrong.add((role, "value_blank", path))
            else:
                good[role, path] = ("N/A", None) if x == "N/A" else ("NONE", None) if x == "none" else ("VALUE", x)
    return good, wrong


def flat(x, at=""):
    return {k2: v2 for k, v in x.items() for k2, v2 in (flat(v, f"{at}{k}.").items() if isinstance(v, dict) else [(f"{at}{k}", v)])}


def test_roles(spark):
    rng = random.Random(11)
    paths = ["font", "font.size", "font.name", "font.name.east", "indent.left", "indent", "tabs", "tabs.a.b"]
    kinds = ["body", "title", "note", "odd"]
    roles = {f"r{k}": (kinds[rng.randrange(2)] if k < 36 else kinds[k % 4], f"r{rng.randrange(k)}" if k and rng.random() < 0.6 else None) for k in range(45)}
    roles |= {"c1": ("body", "c2"), "c2": ("body", "c1"), "m": ("body", "gone"), "t": ("body", "u"), "u": ("title", None)}
    value = lambda: rng.choice(["1", "2", "none", "N/A", "", None, "${p}", "${q}", "${unknown}", "x${p}"])

    def tree(n):  # no path below another in one layer
        out = []
        for p in rng.sample(paths, n):
            if not any(p.startswith(f"{q}.") or q.startswith(f"{p}.") for q in out):
                out.append(p)
        return out

    values = [(r, o, p, value()) for r in roles for o in (False, True) for p in tree(rng.randrange(5))]
    profiles = {k: {p: value() for p in tree(6)} for k in ("body", "title", "odd")}
    required = {k: rng.sample(paths, 6) for k in ("body", "title", "note")}
    parameters = {"p": "12", "q": ""}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got, wrong = S.resolve_roles(
        frame([(r, *v) for r, v in roles.items()], "role_id string, role_type string, based_on string"),
        frame(values, "role_id string, overrides boolean, path string, value string"),
        frame([(k, p, v) for k, own in profiles.items() for p, v in own.items()], "role_type string, path string, value string"),
        frame([(k, p) for k, own in required.items() for p in own], "role_type string, path string"),
        frame([*parameters.items()], "name string, value string"),
    )
    want, bad = plain_roles(roles, values, profiles, required, parameters)
    plain = {(r.role_id, r.path): (r.state, r.value) for r in got.collect()}
    shown = {k: (s, flat(v) if isinstance(v, dict) else v) for k, (s, v) in want.items()}
    nested = {k: (s, {p: x for p, x in json.loads(v).items()}) if isinstance(shown.get(k, (0, 0))[1], dict) else (s, v) for k, (s, v) in plain.items()}
    without = {k: (s, {p: x for p, x in v.items() if x is not None} if isinstance(v, dict) else v) for k, (s, v) in shown.items()}
    assert {k: (s, {p: x for p, x in v.items() if x is not None} if isinstance(v, dict) else v) for k, (s, v) in nested.items()} == without
    assert {tuple(r) for r in wrong.collect()} == bad and len({c for _, c, _ in bad}) >= 7
