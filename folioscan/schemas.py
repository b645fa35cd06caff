"""The relations of a document set.  Keys are ``(doc_key, page, ...)``; boxes are in points, top left origin."""

from __future__ import annotations

BBOX = "x0 double, y0 double, x1 double, y1 double"
POINT = "struct<x:double,y:double>"

DOCUMENT = "doc_key string, name string, source_kind string, n_pages int, metadata map<string,string>"
BOOKMARK = "doc_key string, level int, title string, page int"
TEXT_LINE = f"doc_key string, page int, line_id string, ord int, text string, {BBOX}, rotation double, size double, font string, bold boolean, italic boolean, color string, block string, source string, confidence double"
PAGE_FACTS = "doc_key string, page int, width double, height double, rotation int, label string, n_vector_paths int, image_coverage double, ruling_h int, ruling_v int, n_images int, n_cad_chars int, optical boolean, layers array<string>"
MARKUP = f"doc_key string, page int, markup_id string, uid string, kind string, {BBOX}, text string, author string, subject string, intent string, created string, points_at {POINT}, xref int, irt_xref int, vertices array<{POINT}>"
DOC_TABLE = f"doc_key string, page int, table_id string, {BBOX}, header array<string>, rows array<array<string>>, notes array<string>"
ENTITY = f"doc_key string, page int, id string, ord int, kind string, layer string, color string, style string, source string, confidence double, filled boolean, fill_color string, {BBOX}, vertices array<{POINT}>, closed boolean, center {POINT}, radius double, start_angle double, end_angle double, content string, position {POINT}, height double, text_rotation double"
VIEWPORT = f"doc_key string, page int, {BBOX}, kind string, ratio string, x_unit string, x_per_point double, y_unit string, y_per_point double"
POINT_SET = "set_id string, pid string, cls string, x double, y double"
CONTROL_POINT = "set_id string, name string, px double, py double, easting double, northing double"
LABEL_RUN = "run_id string, ord int, position double, value double"

# Closed vocabularies (fixed values).
PAGE_KINDS = ("blank", "drawing_sheet", "scanned", "form", "figure", "text", "mixed")
ENTITY_KINDS = ("line", "polyline", "arc", "circle", "text", "region", "leader", "dimension")
QUANTITY_KINDS = ("length", "area", "volume", "pressure_or_stress", "force", "unit_weight", "angle", "percent", "elevation", "station", "slope", "count", "other")
CALLOUT_STATUSES = ("resolved", "unresolved", "not_in_document", "cannot_tell")
MARK_STATUSES = ("no_row", "no_mark", "may_be_on_unread_sheet", "cannot_tell")
