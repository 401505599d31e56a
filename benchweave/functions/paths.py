"""What a file path says about its item: entity folder, phase, specimen, source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchweave.functions.names import WHITESPACE, non_blank, optional_id, strip_edges, to_col
from benchweave.schemas import PHASES

# Fixed values: "12. Genus species" folders, specimen codes in file names, image suffixes.
ENTITY_FOLDER = r"^\s*\d+\s*\.\s*(.+?)\s*$"
# The leftmost directory of that form whose name has more than blanks, dots and underscores.
FIRST_ENTITY_FOLDER = r"(?:^|/)(\s*\d+\s*\.\s*[^/]*[^/\s._][^/]*)/"
SPECIMEN_CODE = r"^([A-Za-z]{1,8}\d{2,}[A-Za-z0-9-]*)[_-].*$"
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")


def _parts(path) -> Column:
    return F.array_remove(F.split(to_col(path), "/"), "")


def directories(path) -> Column:
    parts = _parts(path)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def file_name(path) -> Column:
    return F.substring_index(to_col(path), "/", -1)


def extension(path) -> Column:
    """Lower-case suffix with its dot, blank when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def parent_prefix(path) -> Column:
    """Directory part with its closing slash, blank at the root."""
    text = to_col(path)
    return F.substring(text, F.lit(1), F.length(text) - F.length(file_name(text)))


def drop_suffix(path) -> Column:
    return F.concat(parent_prefix(path), stem(path))


def is_image(path, extensions=IMAGE_EXTENSIONS) -> Column:
    return extension(path).isin(*[e.lower() for e in extensions])


def _label(part: Column) -> Column:
    raw = F.regexp_extract(part, ENTITY_FOLDER, 1)
    return strip_edges(F.trim(F.regexp_replace(F.translate(raw, "_", " "), WHITESPACE, " ")))


def entity_folder(path) -> Column:
    """Outermost numbered directory that carries a name; NULL when there is none."""
    return non_blank(F.regexp_extract(to_col(path), FIRST_ENTITY_FOLDER, 1))


def entity_label(folder: Column) -> Column:
    """The name inside a numbered folder, cleaned."""
    return F.coalesce(_label(to_col(folder)), F.lit(""))


def phase_of(path, fallback=None, phases=PHASES) -> Column:
    first = F.get(_parts(path), F.lit(0))
    other = F.lit("") if fallback is None else F.coalesce(to_col(fallback), F.lit(""))
    return F.when(first.isin(*phases), first).otherwise(other)


def specimen_of(path, folder) -> Column:
    """Directories below the entity folder, else a code in the file name, else the bare name."""
    # Plain text steps: each array step would be computed anew wherever its result is used.
    text = F.concat(F.lit("/"), F.array_join(_parts(path), "/"))
    own = F.when(~F.contains(to_col(folder), F.lit("/")), to_col(folder))
    before = F.call_function("substring_index", text, F.concat(F.lit("/"), own, F.lit("/")), F.lit(1))
    after = F.substring(text, F.length(before) + F.length(own) + 3, F.length(text))
    below = F.substring(after, F.lit(1), F.length(after) - F.length(file_name(after)) - 1)
    return F.coalesce(non_blank(below), F.regexp_replace(stem(path), SPECIMEN_CODE, "$1"))


def source_id(dataset, path) -> Column:
    tag = dataset if isinstance(dataset, Column) else F.lit(dataset)
    return F.concat(tag, F.lit(":"), drop_suffix(path))


def join_path(root, path) -> Column:
    base = root if isinstance(root, Column) else F.lit(str(root))
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), to_col(path))


def resolve_path(stored, rel_path, modality, roots) -> Column:
    """A root given for the modality wins when a relative path exists; else the stored path."""
    if isinstance(roots, str):
        roots = {"macro": roots, "micro": roots}
    rel = to_col(rel_path)
    out = to_col(stored)
    for name, root in sorted((roots or {}).items()):
        out = F.when((to_col(modality) == name) & (F.coalesce(rel, F.lit("")) != ""), join_path(root, rel)).otherwise(out)
    return out


def group_key(dataset="dataset_name", modality="modality", species="species", specimen="specimen_id", source="source_id", path="image_path") -> Column:
    """Leak-safe unit: the specimen when known, else the source, else the file itself."""
    spec, src = optional_id(specimen), optional_id(source)
    token = F.when(spec != "", F.concat(F.lit("specimen:"), spec)).otherwise(
        F.concat(F.lit("source:"), F.coalesce(non_blank(src), to_col(path), F.lit("")))
    )
    fields = [F.trim(F.coalesce(to_col(c), F.lit(""))) for c in (dataset, modality, species)]
    return F.concat_ws("|", *fields, token)
