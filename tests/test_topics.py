from citegraph.operators import topics
from conftest import as_set

TREE = [
    (165864922, [190796033, 114009990, 178809742]),
    (114009990, [2909274368, 196033]),
    (178809742, []),
    (2909274368, None),
    (196033, [114009990, 2909274368]),
    (190796033, [190796033]),
]


def test_closure_with_cycle_and_self_loop(make):
    hierarchy = make("id long, child_id array<long>", *TREE)
    roots = make("field_of_study_id long", (165864922,), (77,))
    closure = as_set(topics.topic_closure(hierarchy, roots))
    assert closure == {(165864922, id_) for id_, _ in TREE} | {(77, 77)}


def test_closure_stops_after_five_hops(make):
    hierarchy = make("id long, child_id array<long>", *[(i, [i + 1]) for i in range(10)])
    roots = make("field_of_study_id long", (0,))
    assert {d for _, d in as_set(topics.topic_closure(hierarchy, roots))} == set(range(6))
    assert {d for _, d in as_set(topics.topic_closure(hierarchy, roots, max_hops=2))} == {0, 1, 2}


def test_more_links_are_closed_by_more_tasks(make, monkeypatch):
    monkeypatch.setattr(topics, "LINKS_PER_TASK", 3)
    hierarchy = make("id long, child_id array<long>", (0, [*range(1, 100), None, 1]), (0, [1, 100]), (1, [0]), (2, None))
    closure = topics.topic_closure(hierarchy, make("field_of_study_id long", (0,), (1,)))
    assert as_set(closure) == {(root, i) for root in (0, 1) for i in range(101)} and closure.count() == 202
    plan = closure._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(field_of_study_id" in plan and "REPARTITION_BY_NUM" in plan and ", 35)" in plan


def test_frequency_keeps_unlinked_values(make):
    links = make("paper_id long, field_of_study_id long", (1, 5), (2, 5), (3, 99))
    metadata = make("id long, level int, frequency long", (5, 1, None), (6, 1, 4), (7, 1, None))
    assert as_set(topics.topic_frequency(links, metadata)) == {(5, 1, 2), (6, 1, 4), (7, 1, None)}


def test_percentile_is_truncated_and_strict(make):
    # The 75th percentile of 1, 2, 3, 6 is 3.75 -> 3: only the 6 is above, the null is ignored.
    metadata = make("id long, level int, frequency long", (1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 6), (5, 1, None),
                    (6, 2, 100), (7, 2, 101))
    assert as_set(topics.filter_topics(metadata)) == {(1, 4)}
    assert as_set(topics.filter_topics(metadata, [1, 2], [75, 0])) == {(1, 4), (2, 7)}


def test_yearly_totals_count_a_paper_once(make):
    closure = make("field_of_study_id long, descendant long", (1, 1), (1, 2), (1, 3))
    papers = make("id long, year string, citations int", (10, "2015", 5), (11, "2015", None), (12, "2016", None))
    links = make("paper_id long, field_of_study_id long", (10, 2), (10, 3), (11, 1), (12, 2), (12, 9))
    rows = topics.yearly_topic_totals(papers, links, closure).collect()
    assert {(r["field_of_study_id"], tuple(r["all_children"]), r["year"], r["paper_count"], r["total_citations"])
            for r in rows} == {(1, (1, 2, 3), "2015", 2, 5), (1, (1, 2, 3), "2016", 1, 0)}
