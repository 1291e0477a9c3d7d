"""Tables in: registry, schemas, file scans and table maintenance."""
