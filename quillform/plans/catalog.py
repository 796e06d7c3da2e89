"""All queries of the library's own operators, and their SQL."""

from . import axes, detection, detectors, diagnosis, documents, edits, evidence, forms, geometry, inference, labels, lifecycle, markers, merging, published, records, stores

QUERIES = {**forms.QUERIES, **records.QUERIES, **detection.QUERIES, **stores.QUERIES, **geometry.QUERIES, **labels.QUERIES, **detectors.QUERIES, **diagnosis.QUERIES, **documents.QUERIES, **inference.QUERIES, **axes.QUERIES, **markers.QUERIES, **edits.QUERIES, **lifecycle.QUERIES, **published.QUERIES, **merging.QUERIES, **evidence.QUERIES}
ORACLES = {**forms.ORACLES, **records.ORACLES, **detection.ORACLES, **stores.ORACLES, **geometry.ORACLES, **labels.ORACLES, **detectors.ORACLES, **diagnosis.ORACLES, **documents.ORACLES, **inference.ORACLES, **axes.ORACLES, **markers.ORACLES, **edits.ORACLES, **lifecycle.ORACLES, **published.ORACLES, **merging.ORACLES, **evidence.ORACLES}
