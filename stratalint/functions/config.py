"""Limits of the rules and what they know of packages."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScanConfig:
    function_lines: int = 50
    flat_nesting: int = 2
    file_lines: int = 400
    params: int = 6
    returns: int = 3
    nesting: int = 5
    complexity: int = 10
    bool_flags: int = 3
    decorators: int = 3
    class_methods: int = 25
    class_attrs: int = 20
    class_wmc: int = 50
    inheritance: int = 4
    chain: int = 3
    twin_ratio: float = 0.6
    duplicate_lines: int = 5
    public_symbols: int = 15
    min_methods: int = 2
    fan_in: int = 8
    fan_out: int = 8
    escalation: float = 1.5
    dense_numbers: int = 8
    #: Package -> stem of its modules, for import cycles and coupling; other packages have no import graph.
    stems: dict[str, str] = field(default_factory=dict)
    #: Package -> (path prefix, forbidden import prefixes).
    layers: dict[str, list[tuple[str, list[str]]]] = field(default_factory=dict)
    #: Packages that mustn't import a transport module.
    libraries: tuple[str, ...] = ()
    transports: tuple[str, ...] = ("fastapi", "starlette", "httpx", "flask", "django")
    #: What a suppression marker is called: any word before "-ignore".
    marker: str = r"[A-Za-z]+-ignore"


#: Effort to fix a rule's findings; other rules: 1.
EFFORT = {
    5.0: "import-cycle god-class", 4.0: "layer-violation transport-in-library god-module high-coupling", 3.0: "sync-async-duplication duplicate-function-body high-complexity deep-inheritance",
    2.5: "long-function potential-circular-import long-file", 2.0: "deep-nesting too-many-params scope-mutation",
    1.5: "boolean-flag-params excessive-returns swallowed-exception global-mutable lazy-class", 1.0: "missing-return-type bare-except encapsulation-violation syntax-error message-chain excessive-decorators pass-through-method",
    0.5: "missing-param-type untyped-dict unused-import star-import mutable-default todo-marker dead-code magic-number magic-string missing-else",
}
