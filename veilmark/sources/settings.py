"""Settings of a job from environment variables, and a policy laid over them.

Every name begins with VEILMARK_.  A variable that isn't set, or is empty, leaves the default; a switch is on for 1, true, yes and on in
any case and off for everything else; an unknown dialect or action is an error, as a typo must not switch protection off.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace

from veilmark.operators.config import ScanConfig
from veilmark.operators.infra import INTERNAL_LABELS, InfraConfig
from veilmark.operators.sqltext import DIALECTS
from veilmark.sources.policyfile import LANGUAGES, Policy

ON = ("1", "true", "yes", "on")
DEFAULT_LANGUAGES = tuple(x for x in LANGUAGES if x != "cobol")


def languages(words: list[str]) -> tuple[str, ...]:
    """A list of languages, in which `defaults` and `all` stand for several and `none` or `off` for no language at all."""
    out: dict[str, None] = {}
    for word in (w.strip().lower() for w in words):
        if word in ("none", "off"):
            return ()
        out |= dict.fromkeys(LANGUAGES if word == "all" else DEFAULT_LANGUAGES if word in ("default", "defaults") else [word] if word else [])
    return tuple(out)


@dataclass(frozen=True)
class Settings:
    """What a job masks, and how."""

    on_detect: str = "mask"
    directive: bool = True
    mask_sql: bool = True
    sql_dialect: str = "postgres"
    mask_env: bool = True
    mask_tool_results: bool = True
    mask_members: bool = False
    languages: tuple[str, ...] = DEFAULT_LANGUAGES
    project: str = "."
    scan: ScanConfig = ScanConfig()
    infra: InfraConfig = InfraConfig("")
    scopes: tuple[str, ...] = ()
    prefixes: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @staticmethod
    def read(environ: Mapping[str, str], salt: str = "") -> Settings:
        """Settings from variables such as VEILMARK_ON_DETECT; a ValueError names all that is wrong."""
        said = {k.removeprefix("VEILMARK_").lower(): v for k, v in environ.items() if k.startswith("VEILMARK_") and v != ""}
        wrong = []
        switch = lambda name, otherwise: said[name].strip().lower() in ON if name in said else otherwise

        def one_of(name: str, known: tuple[str, ...], otherwise: str) -> str:
            value = said.get(name, otherwise).strip().lower()
            if value not in known:
                wrong.append(f"VEILMARK_{name.upper()} must be one of {', '.join(known)}")
            return value

        base = Settings()
        made = Settings(
            on_detect=one_of("on_detect", ("mask", "block"), base.on_detect),
            directive=switch("directive", base.directive),
            mask_sql=switch("mask_sql", base.mask_sql),
            sql_dialect=one_of("sql_dialect", DIALECTS, base.sql_dialect),
            mask_env=switch("mask_env", base.mask_env),
            mask_tool_results=switch("mask_tool_results", base.mask_tool_results),
            mask_members=switch("mask_members", base.mask_members),
            languages=languages(re.split(r"[,\s]+", said.get("languages", "defaults"))),
            project=said.get("project", base.project),
            infra=InfraConfig(salt),
        )
        wrong += [f"VEILMARK_LANGUAGES: no such language: {x}" for x in made.languages if x not in LANGUAGES]
        if wrong:
            raise ValueError("; ".join(wrong))
        return made

    def under(self, policy: Policy) -> Settings:
        """These settings with a policy over them: its switches and its list of languages win, its rules and lists are added."""
        switch = lambda name, own: bool(policy.switches.get(name, own))
        merged: dict[str, tuple[str, ...]] = dict(self.prefixes)
        for language, more in policy.prefixes.items():
            merged[language] = tuple(dict.fromkeys((*merged.get(language, ()), *more)))
        labels = (*self.infra.labels, *(x for x in policy.labels if x not in self.infra.labels))
        return replace(
            self,
            mask_sql=switch("sql", self.mask_sql),
            mask_tool_results=switch("fileReads", self.mask_tool_results),
            mask_members=switch("members", self.mask_members),
            languages=self.languages if policy.languages is None else languages(list(policy.languages)),
            scan=policy.scan_config(self.scan),
            infra=replace(self.infra, labels=labels or INTERNAL_LABELS, domains=(*self.infra.domains, *policy.domains)),
            scopes=(*self.scopes, *policy.scopes),
            prefixes=tuple(merged.items()),
        )
