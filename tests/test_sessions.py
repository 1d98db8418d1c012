import json

from plumbline.operators import sessions

SCHEMA = "session_id string, block long, position long, type string, content string"


def event(at, kind, content, session="s"):
    return (session, 0, at, kind, None if content is None else json.dumps(content))


def told(spark, events, **more):
    found = sessions.session_items(spark.createDataFrame(events, SCHEMA), **more)
    return [tuple(r) for r in found.orderBy("session_id", "section", "at").select("section", "text", "outcome", "result").collect()]


def use(id_, command):
    return {"type": "tool_use", "name": "Bash", "id": id_, "input": {"command": command}}


def result(id_, content, failed=None):
    return {"type": "tool_result", "tool_use_id": id_, "content": content, "is_error": failed}


def test_commands_meet_their_results(spark):
    events = [
        event(1, "assistant", [use("a", "ls"), use("b", "rm x"), use(None, "pwd"), use("c", ""), use("d", "late")]),
        event(2, "user", [result("b", "no such file", True), result("a", [{"type": "text", "text": "f"}])]),
        event(3, "user", [result("a", "again", True)])]
    found = told(spark, events)
    assert [x for x in found if x[0] == "commands"] == [
        ("commands", "ls", "ok", '[{"type":"text","text":"f"}]'), ("commands", "rm x", "failed", "no such file"), ("commands", "pwd", "unanswered", None), ("commands", "late", "unanswered", None)]
    assert [x[1] for x in found if x[0] == "errors"] == ["no such file", "again"]


def test_calls_of_other_sessions_do_not_answer(spark):
    events = [event(1, "assistant", [use("a", "ls")], "s"), event(2, "user", [result("a", "x")], "t")]
    assert told(spark, events) == [("commands", "ls", "unanswered", None)]


def test_texts_skills_and_cuts(spark):
    long = "first\n" + "x" * 5000
    events = [event(0, "user", " /plan it\nnow \n"), event(1, "user", "y" * 3000)]
    events += [event(2 + i, "assistant", [{"type": "text", "text": long}, {"type": "text", "text": " "}]) for i in range(4)]
    events += [event(9, "assistant", [{"type": "tool_use", "name": "Skill", "input": {"skill": "chart", "args": "a"}}, {"type": "thinking", "text": "no"}]), event(10, "system", "unsaid")]
    found = told(spark, events)
    assert [x[1] for x in found if x[0] == "prompts"] == ["/plan it\nnow", "y" * 2000]
    assert [x[1] for x in found if x[0] == "skills"] == ["/plan it", "chart a"]
    assert [x[1] for x in found if x[0] == "answers"] == ["first"] + [long[:4000]] * 3


def test_odd_content_gives_no_row(spark):
    events = [event(1, "user", None), event(2, "user", ""), event(3, None, "x"), event(4, "user", {"a": 1}), event(5, "assistant", [None, 3, "s"]), ("s", 0, 6, "user", "[broken"), (None, 0, 7, "user", '"null session"')]
    assert told(spark, events) == [("prompts", "null session", None, None)]
    assert told(spark, []) == []


def test_the_budget_goes_to_the_first_sections(spark):
    events = [event(1, "user", "a" * 6), event(2, "assistant", "b" * 4), event(3, "assistant", [use("a", "c" * 3)]), event(4, "user", "d" * 6)]
    items = sessions.session_items(spark.createDataFrame(events, SCHEMA))
    kept, summary = sessions.session_sections(items, max_chars=11)
    assert sorted(r["text"] for r in kept.collect()) == ["a" * 6, "b" * 4]
    assert [tuple(r) for r in summary.select("kept", "chars", "dropped", "truncated").collect()] == [(2, 10, 2, True)]
