"""Column expressions shared by the operators; nothing in here runs a job."""
