"""Tables an operator writes to cut its lineage, in the folder that the cluster shares."""

from tessera.sources.staging import release, root, stage

__all__ = ["release", "root", "stage"]
