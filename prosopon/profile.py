"""Everything that names one particular dictionary, kept in a parameter object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Editor:
    name: str
    affiliation: str = ""
    orcid: str = ""
    type: str = "Editor"


@dataclass(frozen=True)
class Profile:
    """Markers that the extraction looks for, and the fixed texts that the exports carry.

    The defaults describe an invented dictionary; a project passes its own names.
    """

    dictionary: str = "Lives Register"
    full_title: str = "Lives Register, Biographical Dictionary of Public Office Holders"
    citation_marker: str = "in Lives Register, Biographical Dictionary"
    how_to_cite_marker: str = "how to cite this lives register entry"
    section_labels: tuple[str, ...] = ("ARCHIVES", "PUBLICATIONS", "LITERATURE")
    source_label: str = "Source:"
    version_label: str = "Version"
    media_note_limit: int = 500
    edited_by: str = "the editorial board"
    editors: tuple[Editor, ...] = (Editor("Doe, Jane", "Example University"),)
    home_url: str = "https://lives.example"
    entry_base: str = "https://lives.example/entries/"
    publisher: str = "Lives Register Project"
    place: str = "Example City"
    license: str = "cc-by-nc-nd-4.0"
    publication_type: str = "section"
    rights_note: str = "Text licensed under CC BY-NC-ND 4.0; portraits remain with their credited source."
    render_version: str = ""
    deposit_suffix: str = "-register"
    sandbox_record_base: str = "https://sandbox.example/records/"
    # Fixed values.
    constant_keywords: tuple[str, ...] = ("biography", "Secretary-General", "international organization")
    extra: dict = field(default_factory=dict, hash=False)

    @property
    def provenance(self) -> str:
        return f"Entry in {self.full_title}."
