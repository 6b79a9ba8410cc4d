"""Configuration templates."""

from __future__ import annotations

from collections.abc import Mapping
from string import Template


def substituted(text: str, env: Mapping[str, str]) -> str:
    """${NAME} from env; an unset name is a KeyError."""
    return Template(text).substitute(env)
