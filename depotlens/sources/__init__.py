"""Sources: a data source for file trees and normalisers for connector JSON."""

from .remote import albums, drive_files, media_items, messages  # noqa: F401
from .tree import FileTreeSource, read_tree  # noqa: F401
