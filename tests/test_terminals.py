import pytest

from plantlens.plans import terminals

BLOCK = "block int, name string, key string, address int, left int, right int, low int, high int, rotated boolean, multiple int"


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def case(name, side, ys, n, low=-200, high=30, multiple=None, drawn=()):
    """A symbol of its own: rows on one side, n labels there."""
    return name, side, ys, n, low, high, multiple, drawn


#: A module pitch of 20 on both sides comes from symbols with rows at 20; what each case must give.
CASES = {
    "grid": (case("grid", "input", [0, -20, -60], 4), ("PITCH_SLOT", 0, 20)),
    "no labels": (case("no labels", "input", [0, -20], 0), "NO_LABELS"),
    "no pin": (case("no pin", "input", [], 2), "NO_PIN"),
    "glyph": (case("glyph", "output", [], 3), ("GLYPH_PITCH", 5, 20)),
    "glyph outside": (case("glyph outside", "output", [], 3, low=-20), "GLYPH_OUTSIDE_BOX"),
    "ambiguous": (case("ambiguous", "input", [0, -40], 3), "AMBIGUOUS_PITCH"),
    "manual decides": (case("manual decides", "input", [0, -40], 3, multiple=2), ("PITCH_SLOT", 0, 40)),
    "box decides": (case("box decides", "input", [0, -40], 3, low=-50), ("PITCH_SLOT", 0, 20)),
    "neither fits": (case("neither fits", "input", [0, -40], 3, low=-10), "NO_PITCH_FITS"),
    "above": (case("above", "input", [20, 0], 3), "FIRST_ROW_ABOVE_INSERTION"),
    "above, whole": (case("above, whole", "input", [20, 0], 2), ("PITCH_SLOT", 20, 20)),
    "below": (case("below", "output", [-40], 3), "TOP_ROW_BELOW_INSERTION"),
    "only grid": (case("only grid", "output", [-40], 3, low=-41, high=0), ("PITCH_SLOT", 0, 20)),
    "off grid": (case("off grid", "input", [-5], 2), "ROW_OFF_GRID"),
}


def drawn(cases):
    blocks, pins, labels = [], [], []
    for b, (name, side, ys, n, low, high, multiple, named) in enumerate(cases, 1):
        x = 0 if side == "input" else 100
        blocks.append((b, name, f"{name}|1", 100 * b, -10, 110, low, high, False, multiple))
        pins += [(b, x, y, f"P{y}" if y in named else None, False) for y in ys]
        labels += [(b, side, k, f"S{k + 1}" if side == "input" else "N" if k == 0 else f"N+{k}") for k in range(n)]
    return blocks, pins, labels


def tables(spark, blocks, pins, labels, links=(), specs=(), offsets=()):
    return {
        "blocks": table(spark, BLOCK, blocks), "pins": table(spark, "block int, x int, y int, pin string, wired boolean", pins), "labels": table(spark, "block int, side string, n int, label string", labels),
        "links": table(spark, "ord int, block int, x int, y int, driver int, driver_x int, driver_y int", list(links)),
        "specs": table(spark, "block int, label string, value int", list(specs)), "offsets": table(spark, "block int, offset int", list(offsets)),
    }


def plans_of(spark, cases):
    t = tables(spark, *drawn(cases))
    proven = table(spark, "key string, label string, places int, place_x int, place_y int", [])
    return {r.block: r for r in terminals.slot_plans(t["blocks"], terminals.sided_pins(t["pins"], t["blocks"]), t["labels"], proven).collect() if r.side == cases[r.block - 1][1]}


def test_every_refusal_and_every_grid(spark):
    module = [case(f"m{k}", side, [0, -20], 2) for k in range(4) for side in ("input", "output")]
    cases = [c for c, _ in CASES.values()] + module
    got = plans_of(spark, cases)
    for b, (name, (_, want)) in enumerate(CASES.items(), 1):
        r = got[b]
        assert (r.refusal if isinstance(want, str) else (r.method, r.anchor, r.pitch)) == want, name
    assert {w for _, w in CASES.values() if isinstance(w, str)} | {"NO_PITCH"} == set(terminals.REFUSALS)


def test_no_pitch_without_a_module_pitch(spark):
    assert plans_of(spark, [case("one", "input", [0], 2)])[1].refusal == "NO_PITCH"


def labelled(spark, *args):
    rows = terminals.label_terminals(**tables(spark, *args)).collect()
    return {(r.block, r.label or r.pin): r for r in rows}, rows


def test_claims_in_order_with_conflicts(spark):
    twins = [case("twin", "input", [0, -20, -60], 3, drawn=(0, -20, -60))] * 3 + [case("driver", "output", [0, -20], 2)]
    blocks, pins, labels = drawn(twins)
    # block 4 has address 400; outputs N and N+1
    link = lambda k, block, y: (k, block, 0, y, 4, 100, 0)
    got, rows = labelled(spark, blocks, pins, labels, [link(1, 1, 0)], [(1, "S2", 400)], [(4, 0), (4, 1)])
    assert (got[1, "S2"].method, got[1, "S2"].y, got[1, "S2"].association) == ("WIRE_SPEC_MATCH", 0, "EXPLICIT")
    assert (got[2, "S2"].method, got[2, "S2"].y, got[2, "S2"].association) == ("TEMPLATE_FROM_EXPLICIT", 0, "DERIVED")
    assert (got[1, "S1"].method, got[1, "S1"].y) == ("EXACT_PIN_COUNT", 0)  # weaker evidence is asked label by label
    assert (got[4, "N"].method, got[4, "N+1"].method, got[4, "N+1"].y) == ("WIRE_SPEC_MATCH", "PITCH_SLOT", -20)
    assert sum(r.label is None for r in rows) == 1 * 3  # the pins at -20 that S2 left for another place

    # two places for one label: a conflict on the third instance, no weaker evidence there
    got, _ = labelled(spark, blocks, pins, labels, [link(1, 1, 0), link(2, 2, -60)], [(1, "S2", 400), (2, "S2", 401)], [(4, 0), (4, 1)])
    assert (got[3, "S2"].association, got[3, "S2"].reason, got[3, "S2"].x) == ("CONFLICT", "SEVERAL_PLACES", None)
    assert (got[1, "S2"].y, got[2, "S2"].y) == (0, -60)

    # two specs name outputs of the driver: the wire proves nothing
    got, _ = labelled(spark, blocks, pins, labels, [link(1, 1, 0)], [(1, "S2", 400), (1, "S3", 401)], [(4, 0), (4, 1)])
    assert got[1, "S2"].method == "EXACT_PIN_COUNT" and got[4, "N"].method == "PITCH_SLOT"


def test_rotated_blocks_prove_nothing_and_keep_their_pins(spark):
    blocks, pins, labels = drawn([case("twin", "input", [0, -20], 2, drawn=(0, -20)), case("driver", "output", [0], 1)])
    blocks[0] = (*blocks[0][:8], True, None)
    got, rows = labelled(spark, blocks, pins, labels, [(1, 1, 0, 0, 2, 100, 0)], [(1, "S1", 200)], [(2, 0)])
    assert {(r.pin, r.reason, r.association) for r in rows if r.block == 1} == {("P0", "ROTATED", "UNRESOLVED"), ("P-20", "ROTATED", "UNRESOLVED")}
    assert got[2, "N"].method != "WIRE_SPEC_MATCH"


def test_captions_take_the_nearest_row_of_their_side(spark):
    items = [(1, 0, 0.0, 90.0, "S1"), (1, 1, 0.0, 80.0, "S 2"), (1, 2, 50.0, 90.0, "N"), (1, 3, 50.0, 70.0, "N+1"), (1, 4, 5.0, 81.0, "S T A"), (1, 5, 45.0, 71.0, "D R"), (1, 6, 5.0, 50.0, "far"), (1, 7, 20.0, 99.0, "TITLE"), (1, 8, 3.0, 90.0, "(12)"), (2, 0, 1.0, 1.0, "alone")]
    got = terminals.symbol_captions(
        table(spark, "fc int, item int, x double, y double, text string", items), table(spark, "fc int, blk string, description string", [(1, "N + 1", "Checkpoint overrun")]), table(spark, "fc int, title string", [(1, "TITLE")]),
    ).collect()
    assert {(r.fc, r.text): (r.row_label, r.side) for r in got} == {(1, "STA"): ("S2", "input"), (1, "OR"): ("N+1", "output"), (1, "far"): (None, "body"), (2, "alone"): (None, "body")}


@pytest.mark.parametrize("name", ["label_terminals"])
def test_empty_tables(spark, name):
    assert terminals.label_terminals(**tables(spark, [], [], [])).collect() == []
