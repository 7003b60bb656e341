"""Planning of extra classes and the directory clean-up on small schools."""

import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import cleanup as C
from rollbook.operators import roster as P

CS = "school_id int, class_name string, section string"


def school(seed, sections=14, teachers=9):
    r = random.Random(seed)
    names = [(1, t, f"T{r.randrange(100):02d}-{t}") for t in range(teachers)]
    teaches, lessons = {}, []
    for s in range(sections):
        cn, sec = ["VI", "VII", "VIII"][s % 3], "ABCDE"[s // 3]
        for _ in range(6):
            t, sub, day, hour = r.randrange(teachers), r.choice(["Maths", "Art", "Hindi"]), r.randrange(6), r.randrange(8)
            for key in ((cn, sec), (cn, "*")):
                teaches[(*key, t, sub)] = teaches.get((*key, t, sub), 0) + 1
            lessons.append((1, t, day, False, 480 + 40 * hour, 520 + 40 * hour))
    slots = [(1, d, 760 + 50 * k, 800 + 50 * k) for d in range(5) for k in range(2)] + [(1, 0, 780, 820), (1, 2, 700, 700)]
    offs = [(1, t, r.randrange(6)) for t in range(teachers)]
    limits = [(1, 0, None, None, ["REMEDIAL"]), (1, 1, None, [0, 1], None), (1, 2, None, [2], ["MOD"]), (1, 3, ["2026-01-05"], None, None)]
    return names, teaches, lessons, slots, offs, limits


def frames(spark, data):
    names, teaches, lessons, slots, offs, limits = data
    return dict(
        teaches=spark.createDataFrame([(1, c, s, t, sub, n) for (c, s, t, sub), n in teaches.items()], f"{CS}, teacher_id int, subject string, lessons long"),
        pool=spark.createDataFrame(names, "school_id int, teacher_id int, name string"),
        slots=spark.createDataFrame(slots, "school_id int, day_idx int, start_min int, end_min int"),
        lessons=spark.createDataFrame(lessons, "school_id int, teacher_id int, day_idx int, is_break boolean, start_min int, end_min int"),
        offs=spark.createDataFrame(offs, "school_id int, teacher_id int, day_idx int"),
        restrictions=spark.createDataFrame(limits, "school_id int, teacher_id int, dates array<string>, days array<int>, duties array<string>"),
    )


def allowed(data, most):
    """(check of a whole plan, options of one more session given a plan) by plain rules."""
    names, teaches, lessons, slots, offs, limits = data
    off = set((t, d) for _, t, d in offs)
    away = lambda t, d: any(x == t and (du is None or "REMEDIAL" in du) and da is None and (dy is None or d in dy) for _, x, da, dy, du in limits)

    def options(cn, sec, plan):
        for t in range(len(names)):
            if not any((cn, sec, t, s) in teaches or (cn, "*", t, s) in teaches for s in ("Maths", "Art", "Hindi")):
                continue
            mine = [p for p in plan if p["teacher_id"] == t]
            if len(mine) >= most:
                continue
            for _, d, a, b in slots:
                if a >= b or (t, d) in off or away(t, d) or any(p["day_idx"] == d for p in mine):
                    continue
                if any(x == t and day == d and a < e and s < b for _, x, day, _, s, e in lessons):
                    continue
                if any(p["class_name"] == cn and p["section"] == sec and p["day_idx"] == d and a < p["end_min"] and p["start_min"] < b for p in plan):
                    continue
                yield t, d, a, b

    return options


def test_remedial_plan_keeps_the_rules_and_leaves_nothing_free(spark):
    for seed, per_week, most in ((1, 2, 4), (2, 3, 2)):
        data = school(seed)
        plan = P.plan_remedial(**frames(spark, data), per_week=per_week, most_per_week=most).collect()
        options = allowed(data, most)
        assert plan
        for p in plan:
            rest = [x for x in plan if x is not p]
            assert (p["teacher_id"], p["day_idx"], p["start_min"], p["end_min"]) in set(options(p["class_name"], p["section"], rest)), p
            teaches = data[1]
            assert (p["class_name"], p["section"], p["teacher_id"], p["subject"]) in teaches or p["tier"] == 1
        have = {(p["class_name"], p["section"], p["session"]) for p in plan}
        assert len(have) == len(plan)
        for cn, sec in {(c, s) for c, s, *_ in data[1] if s != "*"}:
            if (cn, sec, per_week) not in have:  # no option may be left for who got none of the last session
                assert not list(options(cn, sec, plan))


def test_two_sections_of_one_teacher_get_different_days(spark):
    data = ([(1, 1, "A")], {("VI", s, 1, "Maths"): 1 for s in "AB"} | {("VI", "*", 1, "Maths"): 2}, [(1, 9, 0, False, 480, 520)], [(1, 0, 760, 800), (1, 1, 760, 800)], [(1, 9, 0)], [(1, 9, None, None, None)])
    plan = P.plan_remedial(**frames(spark, data), per_week=1, most_per_week=4).collect()
    assert {(p["section"], p["day_idx"]) for p in plan} == {("A", 0), ("B", 1)}


def test_remedial_options_do_not_grow_with_the_staff(spark):
    kept = {}
    for teachers, reach in ((40, 1000), (400, 1000), (400, 1)):  # with 1 the rest of the list is read in a second go
        names, _, lessons, slots, offs, limits = school(3, 3, teachers)
        teaches = {(cn, s, t, ("Art", "Maths", "Hindi")[t % 3]): 1 + t % 3 for cn in ("VI", "VII") for s in "A*" for t in range(teachers)}
        data = frames(spark, (names, teaches, lessons, slots, offs, limits))
        rows = P._contenders(**data, per_week=2, by=P.BY, reach=reach).collect()
        kept[teachers, reach] = sorted((r["class_name"], r["section"], r["teacher_id"], r["tier"], sorted(r["slots"])) for r in rows)
    assert kept[400, 1] == kept[400, 1000]
    assert len(kept[400, 1]) < 1.5 * len(kept[40, 1000])  # all 400 stood for every section before


ROWS = "school_id int, teacher_id long, name string, code string, designation string, aliases array<string>, refs long, hard_refs long, has_user boolean"


def directory(spark, rows):
    return spark.createDataFrame([(1, i, n, c, d, a, r, r, u) for i, n, c, d, a, r, u in rows], ROWS)


def test_cleanup_remembers_codes_and_names(spark):
    rows = directory(spark, [
        (1, "Mr. Ravi Kumar", "TGT-MATHS", None, ["R. Kumar"], 5, True),
        (2, "12 Mr. Ravi Kumar TGT-MATH", None, "Warden", ["Ravi"], 9, False),
        (3, "TGT-MATH", None, None, ["maths sir"], 2, False),
        (4, "PGT-ENG", None, None, ["eng"], 2, False),
        (5, "PGT-ENGLISH", "PGT-ENGLISH", "Librarian", ["english"], 1, False),
        (6, "TGT-ART", None, None, [], 1, False),
        (7, "Class timetable of the week", None, None, [], 0, False),
        (8, "Mrs. Rita Das", None, None, ["Rita"], 1, False),
    ])
    plan = C.plan_cleanup(rows)
    told = {r["teacher_id"]: (r["action"], r["keep_id"]) for r in plan.collect()}
    assert told == {1: ("primary", 1), 2: ("merge", 1), 3: ("merge", 1), 4: ("primary", 4), 5: ("merge", 4), 6: ("primary", 6), 7: ("delete", None), 8: ("primary", 8)}
    aliases = {}
    for r in C.cleanup_aliases(rows, plan).collect():
        aliases.setdefault(r["keep_id"], set()).add(r["alias"])
    # the printed code of a merged record, the name of the code record that went to its holder
    assert aliases == {1: {"R. Kumar", "Ravi", "TGT-MATH"}, 4: {"eng", "english", "PGT-ENGLISH"}, 8: {"Rita"}}
    codes = {r["keep_id"]: (r["final_name"], r["final_code"], r["renamed"]) for r in C.code_targets(rows, plan).collect()}
    assert codes == {4: ("PGT-ENG", "PGT-ENG", True), 6: ("TGT-ART", "TGT-ART", True)}
    after = {r["teacher_id"]: (r["name"], r["code"], r["designation"], sorted(r["aliases"])) for r in C.apply_to_directory(rows, plan).collect()}
    assert after == {
        1: ("Mr. Ravi Kumar", "TGT-MATHS", "Warden", ["R. Kumar", "Ravi", "TGT-MATH"]),
        4: ("PGT-ENG", "PGT-ENG", None, ["PGT-ENGLISH", "eng", "english"]),
        6: ("TGT-ART", "TGT-ART", None, []),
        8: ("Mrs. Rita Das", None, None, ["Rita"]),
    }
    fact = spark.createDataFrame([(1, 10, 2, "12 Mr. Ravi Kumar TGT-MATH"), (1, 11, 8, "Rita D."), (1, 12, 5, "PGT-ENGLISH")], "school_id int, seq long, teacher_id long, teacher_name string")
    named = {r["seq"]: (r["teacher_id"], r["teacher_name"]) for r in C.apply_names(C.apply_to_fact(fact, plan), rows, plan).collect()}
    # an untouched record leaves its rows as they were printed
    assert named == {10: (1, "Mr. Ravi Kumar"), 11: (8, "Rita D."), 12: (4, "PGT-ENG")}
    users = spark.createDataFrame([(1, 100, 1), (1, 101, 2), (1, 102, None)], "school_id int, user_id long, teacher_id long")
    assert {r["user_id"]: r["teacher_id"] for r in C.apply_to_logins(users, plan).collect()} == {100: 1, 101: None, 102: None}


def test_codes_tied_only_through_a_held_code_stay_apart(spark):
    rows = directory(spark, [
        (1, "Mr. A Sen", "TGT-SC", None, [], 1, False),
        (2, "Mr. B Roy", "TGT-SCIX", None, [], 1, False),
        (3, "Mr. C Das", "TGT-SCIY", None, [], 1, False),
        (4, "TGT-ME", None, None, [], 1, False),
        (5, "TGT-MEX", None, None, [], 1, False),
        (6, "TGT-MEYY", None, None, [], 1, False),
    ])
    told = {r["teacher_id"]: r["keep_id"] for r in C.plan_cleanup(rows).collect()}
    assert told[4] == told[5] == told[6] == 4
    held = directory(spark, [(1, "Mr. A Sen", "TGT-ME", None, [], 1, False), (2, "Mr. B Roy", "TGT-MEX", None, [], 1, False), (3, "Mr. C Das", "TGT-MEYY", None, [], 1, False), (5, "TGT-MEX", None, None, [], 1, False), (6, "TGT-MEYY", None, None, [], 1, False), (7, "TGT-MEZ", None, None, [], 1, False)])
    told = {r["teacher_id"]: (r["action"], r["keep_id"]) for r in C.plan_cleanup(held).collect()}
    # MEZ belongs to the one who holds ME; MEX and MEYY have two holders each and share no stem
    assert told[7] == ("merge", 1) and told[5] == ("primary", 5) and told[6] == ("primary", 6)


@pytest.mark.parametrize("name", ["all_issues", "issue_summary", "issue_totals"])
def test_rules_keep_no_shuffle_files_for_one_another(views, name):
    """Each rule's issues are written before the next rule runs: what is left joins a row per draft at most."""
    from __spark_entry__ import QUERIES

    plan = QUERIES[name](views.spark, views.path)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "lineitem" not in plan and "l_orderkey" not in plan
