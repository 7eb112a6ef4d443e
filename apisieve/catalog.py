"""A small catalog of rules over public platform APIs, by target."""

from __future__ import annotations

from .plans import Catalog, EventQuery, Rule, Value, any_of

Q = EventQuery


def javascript() -> Catalog:
    return Catalog(
        (
            Rule("js:dynamic-code", "Code is made from text", "warning", "medium", (any_of([Q.call_global("eval"), Q.constructor_global("Function")], "dynamic code"),)),
            Rule("js:string-timer", "A timer runs text as code", "warning", "medium", (Q.call_global("setTimeout").with_arg_static_string(0), Q.call_global("setInterval").with_arg_static_string(0))),
            Rule("js:private-address", "A text holds a private network address", "info", "high", (Q.string_private_network_address(),)),
            Rule("js:wasm", "WebAssembly is compiled", "warning", "medium", tuple(Q.member_call_rooted(f"WebAssembly.{m}") for m in ("compile", "instantiate", "compileStreaming", "instantiateStreaming"))),
        )
    )


def browser() -> Catalog:
    return Catalog(
        (
            Rule("browser:clipboard-read", "The clipboard is read", "info", "high", (Q.member_call_rooted("navigator.clipboard.readText"), Q.member_call_rooted("navigator.clipboard.read"), Q.member_call_rooted("document.execCommand").with_arg(0, Value.equals_any(["paste"])))),
            Rule("browser:clipboard-write", "The clipboard is written", "info", "high", (Q.member_call_rooted("navigator.clipboard.writeText"), Q.member_call_rooted("navigator.clipboard.write"))),
            Rule("browser:geolocation", "The position is read", "info", "high", (Q.member_call_rooted("navigator.geolocation.getCurrentPosition"), Q.member_call_rooted("navigator.geolocation.watchPosition"))),
            Rule("browser:database", "A database object is used", "info", "high", (Q.member_call_returned("indexedDB.open", "addEventListener"),)),
            Rule("browser:cookie", "Cookies are written", "info", "medium", (Q.property_write_rooted("document.cookie"),)),
        )
    )


def node() -> Catalog:
    files = [q for m in ("fs", "node:fs", "fs/promises", "node:fs/promises") for q in (Q.call_module(m, "readFile"), Q.member_call_module(m, "readFile"))]
    processes = [q for m in ("child_process", "node:child_process") for n in ("exec", "spawn", "execFile", "fork") for q in (Q.call_module(m, n), Q.member_call_module(m, n))]
    return Catalog(
        (
            Rule("node:read-file", "Files are read", "info", "high", (any_of(files, "file read"),)),
            Rule("node:child-process", "Processes are started", "warning", "high", (any_of(processes, "child process"),)),
        )
    )


def everything() -> Catalog:
    return javascript().combine(browser()).combine(node())
