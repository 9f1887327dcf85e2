"""Where rows come from: file listings, file contents and extracted text."""
