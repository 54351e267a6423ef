"""Intermediate tables of the operators."""

from __future__ import annotations

from ..scratch import discard as discard, exists as exists, shared_folder as shared_folder, written as written
