"""Reading and writing images, frames, chunks and feedback."""
