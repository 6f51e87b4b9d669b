"""All checks by key."""

from __future__ import annotations

from codesift.plans.checks import code, dependencies, matching, reporting, runs, scans, sources
from codesift.plans.checks.common import Check

CHECKS: dict[str, Check] = {
    **sources.CHECKS, **matching.CHECKS, **reporting.CHECKS, **dependencies.CHECKS, **code.CHECKS,
    **scans.CHECKS, **runs.CHECKS}
