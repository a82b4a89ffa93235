from areaindex.llm import preference


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def brute(rows):
    """Per pair: prompt turns, prompt, completions and masks, from (pair, chosen, turn, role, text)."""
    pairs = {}
    for pair, chosen, turn, role, text in dict.fromkeys(rows):
        if pair is not None and chosen is not None:
            side = pairs.setdefault(pair, (set(), set()))[0 if chosen else 1]
            side.add((turn is not None, turn or 0, "unknown" if role is None else role, text or ""))
    out = {}
    for pair, sides in pairs.items():
        c, r = ([(role, text) for _, _, role, text in sorted(s)] for s in sides)
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        masks = []
        for rest in (c[n:], r[n:]):
            spans = []
            for i, (role, text) in enumerate(rest):
                at = len(render(rest[:i])) + len(f"<|{role}|>\n")
                if role == "assistant":
                    spans.append(f"{at}-{at + len(text) + len('<|end|>')}")
            masks.append(",".join(spans))
        out[pair] = (n, render(c[:n]), render(c[n:]), masks[0], render(r[n:]), masks[1])
    return out


ROWS = [
    (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "good"), (1, True, 2, "user", "more"),
    (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "bad"),
    (2, True, 0, "user", "é😀"), (2, True, 1, "assistant", "same"), (2, True, 2, "assistant", "longer"),
    (2, False, 0, "user", "é😀"), (2, False, 1, "assistant", "same"),
    (3, True, 0, "user", "alone"),
    (4, False, 0, None, None), (4, False, 1, "assistant", ""),
    (5, True, 0, "user", "a"), (5, True, 0, "user", "a"), (5, False, 0, "user", "a"),
    (6, True, None, "user", "first"), (6, True, 0, "user", "tie b"), (6, True, 0, "user", "tie a"),
    (6, False, None, "user", "first"), (6, False, 0, "user", "tie a"), (6, False, 0, "system", "tie a"),
    (None, True, 0, "user", "x"), (7, None, 0, "user", "x"),
    (8, True, 0, "user", "long " * 20_000), (8, False, 0, "user", "long " * 20_000),
    *[(9, s, i, "assistant" if i % 2 else "user", f"turn {i}" if i < 250 or s else "other") for i in range(300) for s in (True, False)],
]


def result(df):
    return {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) for r in preference.format_preferences(df).collect()}


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "pair_id long, chosen boolean, turn long, role string, text string")
    clashing = df.selectExpr("*", "'?' as c", "'?' as r", "'?' as n", "'?' as prompt", "'?' as rejected")
    want = brute(ROWS)
    assert result(df.repartition(3)) == result(clashing) == want
    assert want[1][:2] == (1, "<|user|>\nhi<|end|>\n") and want[5][2] == ""


def test_masks_cover_the_answers(spark):
    df = spark.createDataFrame(ROWS, "pair_id long, chosen boolean, turn long, role string, text string")
    row = result(df)[1]
    (span,) = row[3].split(",")
    a, b = map(int, span.split("-"))
    assert row[2][a:b] == "good<|end|>"


def test_no_python_and_one_shuffle(spark):
    df = spark.createDataFrame(ROWS, "pair_id long, chosen boolean, turn long, role string, text string")
    plan = preference.format_preferences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_neighbours_make_pairs(spark):
    df = spark.createDataFrame([(4, 0, "user", "a"), (5, 0, "user", "a"), (6, 0, "user", "b"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    assert result(preference.neighbour_pairs(df)) == {2: (1, "<|user|>\na<|end|>\n", "", "", "", ""), 3: (0, "", "<|user|>\nb<|end|>\n", "", "", "")}
    assert result(preference.neighbour_pairs(df.limit(0))) == {}
