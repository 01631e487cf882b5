"""Reading, writing, generating and merging key/value vectors."""
