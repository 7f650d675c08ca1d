"""The commands of the platform, as the parser returns them. ``pos`` counts from 0."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Ref:
    """A name, code or number as written, and its place."""

    text: str
    pos: int = 0


@dataclass(frozen=True)
class Value:
    kind: str  # string, number or word
    text: str
    pos: int


@dataclass(frozen=True)
class Assign:
    name: Ref
    value: Value


@dataclass(frozen=True)
class SpecRef:
    dataset: str
    num: int
    pos: int = 0

    def __str__(self) -> str:
        return f"{self.dataset}.{self.num}"


@dataclass(frozen=True)
class Attr:
    name: str
    type_code: str
    is_primary: bool


@dataclass(frozen=True)
class Mode:
    code: Ref
    transfer: str


@dataclass(frozen=True)
class CreateWorkspace:
    schemas: tuple[str, ...]


@dataclass(frozen=True)
class DropWorkspace:
    pass


@dataclass(frozen=True)
class AddSchema:
    schema: Ref


@dataclass(frozen=True)
class CreateDataset:
    type_code: str
    code: Ref
    attrs: tuple[Attr, ...]
    replace: bool = False


@dataclass(frozen=True)
class DropDataset:
    code: Ref


@dataclass(frozen=True)
class CreateBuildSpec:
    spec: SpecRef
    modes: tuple[Mode, ...]
    options: tuple[Assign, ...]
    using: tuple[Ref, ...]
    sources: tuple[Ref, ...]
    body: Ref
    replace: bool = False


@dataclass(frozen=True)
class DropBuildSpec:
    spec: SpecRef


@dataclass(frozen=True)
class CreateFlowSpec:
    name: Ref
    body: Ref
    replace: bool = False


@dataclass(frozen=True)
class DropFlowSpec:
    name: Ref


@dataclass(frozen=True)
class Comment:
    target: str  # workspace, dataset or attr
    text: str | None
    code: Ref | None = None
    attr: Ref | None = None


@dataclass(frozen=True)
class CreateConnection:
    class_code: str
    name: Ref
    fields: tuple[Assign, ...]
    replace: bool = False


@dataclass(frozen=True)
class TestConnection:
    name: Ref
    __test__ = False


@dataclass(frozen=True)
class PythonBlock:
    body: Ref


@dataclass(frozen=True)
class Build:
    spec: SpecRef
    mode: Ref


@dataclass(frozen=True)
class Attach:
    build_id: Ref
    after: int = 0


@dataclass(frozen=True)
class Stop:
    build_id: Ref


@dataclass(frozen=True)
class Fix:
    build_id: Ref


@dataclass(frozen=True)
class Flow:
    preset: Ref | None = None
    intake: str = "calc"
    export: str = "calc"


@dataclass(frozen=True)
class AttachFlow:
    flow_id: Ref
    after: int = 0


@dataclass(frozen=True)
class PauseFlow:
    flow_id: Ref


@dataclass(frozen=True)
class ResumeFlow:
    flow_id: Ref


@dataclass(frozen=True)
class StopFlow:
    flow_id: Ref


#: Tags that commands answer with, as clients know them.
TAGS: dict[type, str] = {
    CreateWorkspace: "CREATE WORKSPACE", DropWorkspace: "DROP WORKSPACE", AddSchema: "ALTER WORKSPACE",
    CreateDataset: "CREATE DATASET", DropDataset: "DROP DATASET", CreateBuildSpec: "CREATE BUILD_SPEC",
    DropBuildSpec: "DROP BUILD_SPEC", CreateFlowSpec: "CREATE FLOW_SPEC", DropFlowSpec: "DROP FLOW_SPEC",
    Comment: "COMMENT", CreateConnection: "CREATE CONNECTION", TestConnection: "TEST", PythonBlock: "PYTHON",
    Build: "BUILD", Attach: "ATTACH", Stop: "STOP", Fix: "FIX", Flow: "FLOW", AttachFlow: "ATTACH",
    PauseFlow: "PAUSE", ResumeFlow: "RESUME", StopFlow: "STOP",
}


@dataclass
class Answer:
    """What a command gives back: a tag, perhaps a number, and lines that were printed."""

    tag: str
    column: str | None = None
    value: int | None = None
    lines: list[str] = field(default_factory=list)
