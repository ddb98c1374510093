"""Small hand-made traces shared by the tests."""

import base64
import json

MS = 1_000_000


def write(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def lines(entries):
    return "\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries) + "\n"


def at(second):
    return f"2024-05-01T10:{int(second) // 60:02}:{int(second) % 60:02}.{int(second * 1000) % 1000:03}Z"


def user(uuid, second, content, parent=None, session="S1", **more):
    return {"uuid": uuid, "parentUuid": parent, "type": "user", "timestamp": at(second),
            "sessionId": session, "message": {"role": "user", "content": content}, **more}


def reply(uuid, second, content, request, parent=None, session="S1", stop=None, usage=(1, 1), **more):
    message = {"id": f"m-{uuid}", "model": "big-1", "content": content,
               "usage": {"input_tokens": usage[0], "output_tokens": usage[1]}}
    if stop:
        message["stop_reason"] = stop
    return {"uuid": uuid, "parentUuid": parent, "type": "assistant", "timestamp": at(second),
            "sessionId": session, "requestId": request, "message": message, **more}


def use(tool_id, name, **tool_input):
    return {"type": "tool_use", "id": tool_id, "name": name, "input": tool_input}


def result(tool_id, content, **more):
    return {"type": "tool_result", "tool_use_id": tool_id, "content": content, **more}


def failed_edit(session="S1"):
    """One prompt, two inferences, a good read and a failed edit."""
    s = session
    return [
        {"type": "mode", "sessionId": s},
        user(f"{s}u1", 0, "Fix the config please", session=s, cwd="/repo", gitBranch="main"),
        reply(f"{s}a1", 2, [{"type": "thinking", "thinking": "hm"}], f"{s}r1", f"{s}u1", s, usage=(10, 5)),
        reply(f"{s}a2", 3, [use(f"{s}t1", "Read", file_path="/repo/config.ts"),
                            use(f"{s}t2", "Edit", file_path="/repo/packages/web/foo.ts")],
              f"{s}r1", f"{s}a1", s, "tool_use", (10, 9)),
        user(f"{s}u2", 4.5, [result(f"{s}t1", "file text")], f"{s}a2", s),
        user(f"{s}u3", 5, [result(f"{s}t2", [{"type": "text", "text": "String to replace not found"}],
                                  is_error=True)], f"{s}u2", s),
        "not json",
        "",
        reply(f"{s}a3", 7, [{"type": "text", "text": "Could not edit."}], f"{s}r2", f"{s}u3", s,
              "end_turn", (3, 7)),
        {"uuid": f"{s}d1", "type": "system", "subtype": "turn_duration", "timestamp": at(8),
         "sessionId": s},
    ]


def b64(number, size=8):
    return base64.b64encode(number.to_bytes(size, "big")).decode()


def span(number, parent, start, end, kind, **attributes):
    attrs = {"span.type": kind, **{k.replace("__", "."): v for k, v in attributes.items()}}
    made = {
        "traceId": b64(7, 16), "spanId": b64(number), "name": kind,
        "startTimeUnixNano": str(start * MS), "endTimeUnixNano": str(end * MS),
        "attributes": [
            {"key": k, "value": {"stringValue": v} if isinstance(v, str) else {"intValue": str(v)}}
            for k, v in attrs.items()
        ],
    }
    if parent:
        made["parentSpanId"] = b64(parent)
    return made


def trace(*spans):
    return {"batches": [{"scopeSpans": [{"spans": list(spans)}]}]}


def log(name, ms, seq, **more):
    return {"timestamp_ns": ms * MS, "event_sequence": str(seq), "span_id": "", "session_id": None,
            "event_name": name, **more}


def traced_session():
    """A prompt, two inferences, a tool with a wait and an execution, and their log events."""
    spans = [
        span(1, None, 90, 500, "interaction", session__id="O1", user__id="ann",
             interaction__sequence=0, user_prompt="add a thing"),
        span(2, 1, 100, 200, "llm_request", model="big", input_tokens=3, output_tokens="4 or so",
             request_id="q1", query_source="repl_main_thread"),
        span(3, 1, 150, 250, "tool", tool_name="Read"),
        span(4, 3, 151, 152, "tool.blocked_on_user"),
        span(5, 3, 152, 249, "tool.execution"),
        span(6, 1, 300, 400, "llm_request", model="big", input_tokens=3, output_tokens=4,
             request_id="q2", query_source="repl_main_thread"),
        span(7, 5, 160, 170, "llm_request", model="Small-Haiku", input_tokens=1, output_tokens=1),
    ]
    first = {"system": "sys", "messages": [{"role": "user", "content": "hi"}]}
    said = {"content": [use("tu1", "Read", file_path="/x/a.py")], "stop_reason": "tool_use"}
    cut = ('{"system":"sys","messages":[{"role":"user","content":"hi"},{"role":"user","content":'
           '[{"type":"tool_result","tool_use_id":"tu1","content":"ok"}]},'
           '{"role":"user","content":"cut [TRUNCATED')
    logs = [
        log("api_request_body", 100, 1, body=json.dumps(first)),
        log("api_response_body", 200, 2, request_id="q1", body=json.dumps(said)),
        log("api_request", 200, 3, request_id="q1", cost_usd="0.25"),
        log("tool_decision", 151, 4, tool_use_id="tu1", tool_input='{"file_path":"/x/a.py"}'),
        log("hook_execution_start", 140, 5, hook_name="PreToolUse:Read"),
        log("hook_execution_complete", 145, 6, hook_name="PreToolUse:Read"),
        log("api_request_body", 300, 7, body=cut),
        log("api_response_body", 400, 8, request_id="q2",
            body=json.dumps({"content": [{"type": "text", "text": "done"}], "stop_reason": "end_turn"})),
        log("api_request", 400, 9, request_id="unknown", cost_usd="9"),
        log("hook_execution_start", 450, 10, hook_name="Stop"),
        log("hook_execution_start", 260, 11, hook_name="PostToolUse:Read"),
    ]
    return trace(*spans), logs
