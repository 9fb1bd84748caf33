"""Tables, documents and logs in; rewritten tables out."""
