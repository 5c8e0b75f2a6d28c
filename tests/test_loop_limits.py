"""Replay of logged cycles: what a limit ends is not resolved, and the outcome is that of the whole log."""

from pagewarden.functions import fixed
from pagewarden.plans import flows

CYCLE = "event_id bigint, task_id bigint, page_id bigint, cycle int, task string, model_text string, elapsed_s int, executed boolean"
ELEMENT = "page_id bigint, ord int, type string, tag string, input_type string, text string, aria_label string, placeholder string, name string, id string"
CLICK = '[{"action":"click","target":"Save"}]'


def rows():
    out = []

    def add(task, cycle, text=CLICK, elapsed=1, executed=True, goal="read the page"):
        out.append((len(out), task, task, cycle, goal, text, elapsed, executed))

    for n in range(1, 31):
        add(1, n)  # goes on until the replan limit
    for n in range(1, 4):
        add(2, n, elapsed=50 * n)  # runtime limit at cycle 3
    for n in range(1, 30):
        add(3, n, executed=n != 4)  # ends before any limit
    add(4, 25)  # nothing but a cycle past the limit
    add(5, 1, elapsed=None)
    add(5, 2, elapsed=None)  # unfinished
    return out


def test_cycles_past_a_limit(spark, monkeypatch):
    seen, decided = [], flows.decided_cycles
    monkeypatch.setattr(flows, "decided_cycles", lambda c, e: seen.append(c) or decided(c, e))
    elements = spark.createDataFrame([(p, 0, "button", "button", "", "Save", "", "", "", "") for p in range(1, 9)], ELEMENT)
    got = flows.loop_replay(spark.createDataFrame(rows(), CYCLE), elements, "chosen_value", "true").collect()
    assert {r.task_id: (r.ended_by, r.cycle, r.result) for r in got} == {
        1: ("replan_limit", 7, "failed"), 2: ("runtime_limit", 3, "failed"), 3: ("execution_failed", 4, "failed"),
        4: ("action_limit", 25, "failed"), 5: ("unfinished", 2, "failed"),
    }
    assert max(r.cycle for r in seen[0].collect()) == fixed.MAX_REPLANS + 1
    assert seen[0].filter(f"elapsed_s > {fixed.MAX_SECONDS}").count() == 0
