"""Input profiles and ingestion plans: strict documents that drive DataFrame construction."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, fields

from loomwright.functions import glob

KINDS = ("record-map", "dialogue-pair", "chat-messages", "ranked-conversation-tree", "bounded-text", "xml-record")
#: What each profile requires, and which options it may hold besides.
REQUIRED = {
    "record-map": ("text",), "dialogue-pair": ("text", "response"), "chat-messages": ("role", "content"),
    "ranked-conversation-tree": ("replies", "text", "rank"), "bounded-text": ("start", "stop"), "xml-record": ("text",),
}
COMMON = ("id", "date", "language", "license")
ALLOWED = {
    "record-map": (*COMMON, "text_fallback", "source", "meta"), "dialogue-pair": (*COMMON, "context", "tools", "meta"), "chat-messages": (*COMMON, "system", "tools", "source", "meta", "role_aliases"),
    "ranked-conversation-tree": (*COMMON, "root", "missing_rank", "role", "assistant_role"), "bounded-text": (), "xml-record": (*COMMON, "source", "meta", "exclude", "source_prefix", "on_malformed"),
}
FORMATS = {
    "record-map": ("json", "jsonl", "parquet"), "dialogue-pair": ("json", "jsonl", "parquet"), "chat-messages": ("json", "jsonl", "parquet"),
    "ranked-conversation-tree": ("json", "jsonl"), "bounded-text": ("text",), "xml-record": ("xml",),
}


@dataclass(frozen=True)
class Profile:
    """How records of one layout become canonical rows."""

    kind: str
    options: dict = field(default_factory=dict)
    on_empty: str = "error"
    nul: str = ""
    main_content: dict = field(default_factory=dict)
    license_policy: tuple[str, ...] = ()

    @staticmethod
    def parse(document: str) -> Profile:
        """From JSON; unknown fields and repeated keys are errors."""

        def unique(pairs):
            out = dict(pairs)
            if len(out) != len(pairs):
                raise ValueError("repeated key in a profile")
            return out

        raw = json.loads(document, object_pairs_hook=unique, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(f"{c} isn't finite")))
        unknown = set(raw) - {f.name for f in fields(Profile)}
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        raw["license_policy"] = tuple(raw.get("license_policy", ()))
        return Profile(**raw).checked()

    def checked(self) -> Profile:
        if self.kind not in KINDS:
            raise ValueError(f"unknown profile {self.kind!r}")
        missing = [r for r in REQUIRED[self.kind] if not self.options.get(r)]
        if missing:
            raise ValueError(f"{self.kind} needs {missing}")
        extra = set(self.options) - set(REQUIRED[self.kind]) - set(ALLOWED[self.kind])
        if extra:
            raise ValueError(f"{self.kind} doesn't take {sorted(extra)}")
        if self.on_empty not in ("error", "skip"):
            raise ValueError("on_empty is error or skip")
        if self.nul not in ("", "error", "space"):
            raise ValueError("nul is error or space")
        if self.kind == "bounded-text":
            for side in ("start", "stop"):
                re.compile(self.options[side])
        if self.kind == "xml-record" and not str(self.options["text"]).startswith("/"):
            raise ValueError("an XML path is absolute")
        for p in self.license_policy:
            glob.to_regex(p)
        return self

    @property
    def replaces_nul(self) -> bool:
        """Profiles of records replace NUL by a space unless told otherwise."""
        return (self.nul or ("space" if self.kind not in ("bounded-text",) else "error")) == "space"

    @property
    def conversations(self) -> bool:
        return self.kind in ("dialogue-pair", "chat-messages", "ranked-conversation-tree")


@dataclass(frozen=True)
class Input:
    path: str
    format: str
    license: str
    profile: Profile | None = None
    text_column: str | None = None


@dataclass(frozen=True)
class Plan:
    """Inputs in order and the limits of what is written; its digest is its identity."""

    inputs: tuple[Input, ...]
    object_bytes: int = 256 << 20
    record_bytes: int = 64 << 20
    canonical_order: bool = False
    direct: bool = False

    def checked(self) -> Plan:
        if not self.inputs:
            raise ValueError("a plan needs inputs")
        paths = [i.path for i in self.inputs]
        if paths != sorted(set(paths)):
            raise ValueError("inputs are sorted and unique")
        kinds = {bool(i.profile and i.profile.conversations) for i in self.inputs}
        if len(kinds) > 1:
            raise ValueError("texts and conversations don't mix in a plan")
        for i in self.inputs:
            if i.profile is None and i.format in ("json", "xml"):
                raise ValueError(f"{i.format} needs a profile")
            if i.profile is None and i.format in ("parquet", "jsonl") and not i.text_column:
                raise ValueError(f"{i.format} needs a profile or a text column")
            if i.profile is not None and i.format not in FORMATS[i.profile.kind]:
                raise ValueError(f"{i.profile.kind} doesn't read {i.format}")
        return self

    def identity(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def choose_format(detected: str, declared: str | None = None, forced: str | None = None, source_code: bool = False) -> str:
    """Forced over declared over detected; source code reads every textual format as text."""
    chosen = forced or declared or detected
    return "text" if source_code and chosen in ("markdown", "html", "xml", "json", "jsonl") and not forced else chosen
