"""Training-data operators: quality, de-duplication, decontamination, packing, archives and scoring."""
