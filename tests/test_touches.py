"""Touch typing beside a loop over the rows, rule by rule in order."""

import random

import pytest

from matchloom.operators import normalize as N

SCHEMA = "match_id long, action_id long, period_id int, event_type string, team_id string, player_id string, receiver_player_id string, success boolean, spadl_type string"
BASE = {"Pass": "pass", "Cross": "cross", "Shot": "shot", "Clearance": "clearance", "Interception": "interception", "Foul": "foul"}


def loop(rows):
    """Rows of one match in order; types are written as the loop goes, so later rows see earlier decisions."""
    kind, team, me, other, good = ([r[i] for r in rows] for i in (3, 4, 5, 6, 7))
    out, n = [r[8] for r in rows], len(rows)
    duels = lambda i: [j for j in (i - 1, i + 1, i + 2) if 0 <= j < n and kind[j] == "GroundDuel"]
    for i in range(n):
        if kind[i] != "OtherBallAction":
            continue
        recent = next((j for j in range(i - 1, -1, -1) if kind[j] is None or "Duel" not in kind[j]), None)
        was = None if recent is None else out[recent]
        aerial = any(0 <= j < n and kind[j] == "AerialDuel" and me[j] == me[i] for j in (i - 1, i + 1))
        if recent is not None and other[recent] == me[i] and not good[recent]:
            if kind[recent] in ("Pass", "Cross"):
                out[i] = "clearance" if aerial else "interception"
                continue
            if kind[recent] == "Shot":
                out[i] = "shot_block"
                continue
        if recent is not None and kind[recent] == "Clearance":
            out[i] = "ball_recovery"
        again = "interception" if was in ("interception", "clearance") else "tackle"
        if i + 1 < n and kind[i + 1] == "GroundDuel":
            touched = i > 0 and kind[i - 1] == "OtherBallAction"
            if me[i + 1] == me[i]:
                if touched and other[i + 1] == me[i - 1]:
                    out[i - 1], out[i] = "dispossessed", "tackle"
                    continue
                if recent is not None and team[recent] != team[i]:
                    out[i] = again
                    continue
            if other[i + 1] == me[i]:
                out[i] = "dispossessed"
                if touched and me[i + 1] == me[i - 1]:
                    out[i - 1] = "tackle"
                continue
        if i > 0 and kind[i - 1] == "GroundDuel" and me[i] in (me[i - 1], other[i - 1]):
            out[i] = again
            continue
        if not any(me[i] in (me[j], other[j]) for j in duels(i)) and i + 1 < n and me[i + 1] != me[i]:
            out[i] = "bad_touch"
    typed = [i for i in range(n) if out[i] is not None]
    for i in typed:
        if out[i] in N.ALWAYS_GOOD:
            good[i] = True
        elif out[i] in N.NEVER_GOOD:
            good[i] = False
        elif out[i] in N.GOOD_IF_KEPT:
            later = [j for j in typed if j > i]
            good[i] = bool(later) and rows[later[0]][2] == rows[i][2] and team[later[0]] == team[i]
    return [(r[0], r[1], t, g) for r, t, g in zip(rows, out, good)]


@pytest.mark.parametrize("players", [3, 5, 12])
def test_touch_types(spark, players):
    r = random.Random(players)
    kinds = ["OtherBallAction"] * 6 + ["AerialDuel", "GroundDuel", "GroundDuel", "GroundDuel", "Pass", "Cross", "Shot", "Clearance", "Interception", "Foul", None, "FinalWhistle"]
    rows = []
    for match in range(60):
        for i in range(r.randint(1, 50)):
            kind, who = r.choice(kinds), r.choice([None] + [f"P{j}" for j in range(players)]) if r.random() < 0.1 else f"P{r.randrange(players)}"
            team = None if who is None else f"T{int(who[1:]) % 2}"
            rows.append((match, i, 1 + (i > 25), kind, team, who, r.choice([None, *[f"P{j}" for j in range(players)]]), r.choice([True, False, False]) if kind in ("Pass", "Cross", "Shot") else None, BASE.get(kind)))
    # a touch without a player: nobody's duel or pass is its own
    rows = [x if x[3] != "OtherBallAction" or x[5] is not None else (*x[:3], "FinalWhistle", *x[4:]) for x in rows]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA)
    got = sorted((x.match_id, x.action_id, x.spadl_type, x.success) for x in N.touch_types(df).collect())
    want = sorted(y for m in range(60) for y in loop([x for x in rows if x[0] == m]))
    assert got == want


def test_every_rule_fires(spark):
    import os

    from matchloom.plans import q_normalize as Q

    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(d):
        pytest.skip("no tables")
    rules = {x.rule for x in Q.touch_types(spark, d).select("rule").distinct().collect()}
    assert rules >= {"received", "blocked", "won_from_touch", "won_from_team", "lost", "after_duel", "no_duel", "recovery", "told"}
    assert N.touch_types(spark.createDataFrame([], SCHEMA)).count() == 0
