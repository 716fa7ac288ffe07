"""The registry of detectors: what each is called, which tables it reads, and what it makes of them.

A detector is a name of its own, the names of its inputs, and a function of them to
findings.  Inputs are record tables, `laid` (glyphs and shapes dealt out by page, made
once for all that read it), `unread` (files whose text was not read), or tables from
outside: `ocr` and `previews`.  Only inputs of the chosen detectors are ever read, and
detectors whose outside tables are not there are left out.  More can be registered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import characters, geometry, metadata, revisions, sheets, slides
from ..operators.findings import union

OUTSIDE = ("ocr", "previews")


@dataclass(frozen=True)
class Detector:
    name: str
    inputs: tuple[str, ...]
    find: Callable[..., DataFrame]


REGISTRY: dict[str, Detector] = {}


def register(name: str, find: Callable[..., DataFrame], *inputs: str) -> Detector:
    if name in REGISTRY:
        raise ValueError(f"there is a detector {name} already")
    REGISTRY[name] = Detector(name, inputs, find)
    return REGISTRY[name]


for _name, _find, *_inputs in (
    ("zero-width", characters.zero_width, "units"),
    ("bidi-control", characters.bidi_control, "units"),
    ("tag-characters", characters.tag_characters, "units"),
    ("mixed-script", characters.mixed_script, "units"),
    ("covered-text", geometry.covered, "laid", "pages"),
    ("text-under-image", geometry.under_image, "laid", "pages"),
    ("annotation-comment", geometry.annotation_comments, "annotations"),
    ("invisible-text", geometry.invisible, "laid"),
    ("low-contrast-text", geometry.low_contrast, "laid"),
    ("off-page-text", geometry.off_page, "laid", "pages"),
    ("deleted-text", revisions.deleted_text, "revisions"),
    ("comment", revisions.comments, "comments"),
    ("revision-history", revisions.revision_history, "revisions", "comments"),
    ("hidden-sheet", sheets.hidden_sheets, "sheets", "cells"),
    ("hidden-rows", sheets.hidden_rows, "sheets", "cells", "hidden_axis"),
    ("hidden-columns", sheets.hidden_columns, "sheets", "cells", "hidden_axis"),
    ("filtered-rows", sheets.filtered_rows, "sheets", "cells", "hidden_axis"),
    ("changed-cell", sheets.changed_cells, "sheets", "cells", "cell_changes"),
    ("hidden-slide", slides.hidden_slides, "slides"),
    ("speaker-notes", slides.speaker_notes, "slides"),
    ("hidden-text", revisions.word_hidden, "word_hidden"),
    ("stale-thumbnail", metadata.stale_thumbnail, "images"),
    ("earlier-revision", revisions.earlier_revisions, "earlier", "units"),
    ("attached-file", revisions.attached_files, "attachments"),
    ("undisclosed-metadata", metadata.undisclosed, "meta_fields", "units", "unread"),
    ("metadata-path", metadata.paths, "meta_fields"),
    ("time-conflict", metadata.time_conflicts, "meta_fields"),
    ("copy-conflict", metadata.copy_conflicts, "meta_fields"),
    ("edit-trail", metadata.edit_trail, "meta_history"),
    ("unrendered-text", geometry.unrendered, "laid", "ocr"),
    ("unextractable-text", geometry.unextractable, "laid", "ocr"),
    ("unseen-words", geometry.unseen_words, "previews", "ocr"),
):
    register(_name, _find, *_inputs)


def chosen(only: Iterable[str] | None = None, there: Iterable[str] = ()) -> list[Detector]:
    """The named detectors (all, if none are named), less those that need an outside table that is not there."""
    names = list(REGISTRY) if only is None else list(dict.fromkeys(only))
    if unknown := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"there is no detector {', '.join(unknown)}")
    there = set(there)
    return [d for n in names for d in [REGISTRY[n]] if all(i in there for i in d.inputs if i in OUTSIDE)]


def tables_of(detectors: Iterable[Detector]) -> list[str]:
    """The inputs that these detectors read, each once."""
    return list(dict.fromkeys(i for d in detectors for i in d.inputs))


def found(detectors: Iterable[Detector], table: Callable[[str], DataFrame], outside: Mapping[str, DataFrame]) -> DataFrame:
    """All their findings.  table is asked once for each input that is not an outside one."""
    detectors = list(detectors)
    if not detectors:
        raise ValueError("no detector is left to run")
    inputs = {i: outside[i] if i in OUTSIDE else table(i) for i in tables_of(detectors)}
    return union([d.find(*(inputs[i] for i in d.inputs)) for d in detectors])
