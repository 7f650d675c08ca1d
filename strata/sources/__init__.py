"""Where rows come from and go to: files, the metadata log, dataset storage, connectors."""
